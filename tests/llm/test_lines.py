import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from querent.llm import lines

SCHEMA = "doc_id long, text string, version string, line string, _gone string"


def brute(rows, least):
    leaves = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        for n, raw in enumerate((t or "").split("\n")):
            if raw := raw.strip(" \t\r\f\x0b"):
                tokens = re.split("[ \t\r\f\x0b]+", raw)
                lead = tuple(lines.FIELD if re.search("[0-9]", x) else x for x in tokens[: lines.DEPTH])
                leaves[len(tokens), lead].append((d, t, n, tokens, k))
    gone = defaultdict(set)
    for (size, _), members in leaves.items():
        if len({t for _, t, *_ in members}) < least:
            continue
        once = {(t, tuple(x)) for _, t, _, x, _ in members}
        template = []
        for place in range(size):
            top = max(Counter(x[place] for _, x in once).items(), key=lambda c: (c[1], c[0].encode()))
            template.append(top[0] if 2 * top[1] >= len(once) else None)
        like = [m for m in members if 100 * sum(a == b for a, b in zip(m[3], template)) >= lines.ALIKE * size]
        if len({m[1] for m in like}) >= least:
            first = min((m[0] for m in like if m[0] is not None), default=None)
            for d, _, n, _, k in like:
                if d is not None and d > first:
                    gone[k].add(n)
    return [(d, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[k])) for k, (d, t) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    body = lambda: " ".join(rng.choice("the of and cat dog run é".split()) for _ in range(rng.randrange(1, 9)))
    rows = []
    for d in range(80):
        parts = [body() for _ in range(rng.randrange(1, 5))]
        if d % 2:
            parts.insert(0, f"Page {d} of {rng.randrange(9)} printed by user{d} on site")
        if d % 3 == 0:
            parts.append("All rights  reserved.\t")
        rows.append((d * 5 % 83, "\n".join([*parts, ""])))
    return [*rows, (100, None), (101, ""), (102, "\n\n"), (None, "All rights reserved."), (None, None), rows[2], (103, "x " * 5000), (3, "All rights reserved.")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "v", "l", "g") for d, t in rows], SCHEMA)
    out = lines.line_deduplicated(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(brute(rows, lines.MIN_TEXTS), key=str)


def test_variable_fields_and_first_document(spark):
    rows = [(k, f"own text {k * 'z'}\nPage {k} of 90 seen by visitor{k} today") for k in range(1, 9)]
    got = {r.doc_id: r.text for r in lines.line_deduplicated(spark.createDataFrame([(d, t, "", "", "") for d, t in rows], SCHEMA)).collect()}
    assert got[1] == rows[0][1] and all(got[k] == f"own text {k * 'z'}" for k in range(2, 9))


def test_copies_alone_make_no_template(spark):
    rows = [(k, "one line of text\nanother line", "", "", "") for k in range(20)]
    assert {r.text for r in lines.line_deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()} == {"one line of text\nanother line"}


def test_empty(spark):
    assert lines.line_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_twin(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = sorted(tuple(r) for r in lines.line_digests(spark.read.parquet(path)).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    assert got == sorted(con.sql(lines.ORACLE).fetchall())
    assert sum(r[2] for r in got) > 100
    assert hashlib.sha256(b"").hexdigest() not in {r[3] for r in got if r[1] == 1 and r[2] == 0}


def kept(spark, rows):
    return {r.doc_id: r.text for r in lines.line_deduplicated(spark.createDataFrame([(d, t, "", "", "") for d, t in rows], SCHEMA)).collect()}


def test_lines_off_the_template_stay(spark):
    base = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    rows = [(k, " ".join(base)) for k in range(1, 8)]
    own = base.copy()
    for k in range(10, 75, 3):
        own[k] = f"own{chr(97 + k % 26)}"
    rows.append((20, " ".join(own)))
    assert kept(spark, [(d, f"{t}\nend {d * 'z'}") for d, t in rows])[20].split("\n")[0] == " ".join(own)


def test_several_templates_of_a_leaf(spark):
    names, towns = "anna bert carl dora emil".split(), "ulm bonn jena kiel trier".split()
    rows = [(k, "please see the page about cats and dogs of our town today") for k in range(1, 9)]
    rows += [(k, "please see the page with maps for hikers from the north here") for k in range(11, 19)]
    rows += [(30 + k, f"please see the page by {names[k % 5]} living in {towns[k // 5]} since spring") for k in range(25)]
    rows += [(60, "please see the page by anna living in ulm since autumn")]
    got = kept(spark, [(d, f"{t}\nend {d * 'z'}") for d, t in rows])
    assert {d for d, t in got.items() if "please" in t} == {1, 11, 30, 60}


def test_five_near_copies_are_no_template(spark):
    base = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)]
    rows = [(d, " ".join([*base[: 10 * d], f"own{d * 'z'}", *base[10 * d + 1 :]])) for d in range(1, 7)]
    assert kept(spark, rows) == dict(rows)
