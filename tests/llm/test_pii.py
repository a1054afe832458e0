import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from querent.llm.pii import luhn, personal_data, redacted, scan

SCHEMA = "doc_id long, text string, spans string, n_email string"


def plain(text):
    """The base patterns as given, by the plain regular expressions."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "+", "%", "12", "255", "4242", "4242 4242 4242 4242", "1.2.3.4", " ", "\n", "(", ")", "x@y.z", "é", "+1 (555) 555-4444", "٣", "@d.e"]), max_size=30))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    base, every = scan(text)
    assert base == plain(text) and set(base) <= set(every)


def added(text):
    base, every = scan(text)
    return [(kind, text[a:b]) for kind, a, b in every if (kind, a, b) not in base]


def test_disguises_map_back_to_the_source():
    assert added("mail me: john.doe (at) example [dot] com now") == [("email", "john.doe (at) example [dot] com")]
    assert added("jane at mail dot example dot org!") == [("email", "jane at mail dot example dot org")]
    assert added("é jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert added("bob＠example．com") == [("email", "bob＠example．com")]
    assert added("call plus one five five five one two three four five six seven ok") == [("phone", "plus one five five five one two three four five six seven")]
    assert added("card four two four two 4242 4242 four two four two end") == [("card", "four two four two 4242 4242 four two four two")]
    assert added("at 10.0.0.one dot") == [("ip", "10.0.0.one")]
    assert added("jo​hn@exam​ple.com") in ([("email", "jo​hn@exam​ple.com")], [])
    assert added("one two three of us met at noon. Then two more at home") == []
    assert added("x at once.Then go") in ([], [("email", "x at once.Then")])


# Spelled digits of the four languages, by digit.
SPOKEN = {
    "en": "zero one two three four five six seven eight nine".split(),
    "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}
AT = {"en": "at", "fr": "arobase", "de": "at", "es": "arroba"}
DOT = {"en": "dot", "fr": "point", "de": "punkt", "es": "punto"}


def planted(rng, kind, lang):
    """One identifier of a kind under a disguise of a language, as it may stand in a text."""
    spell = lambda digits: " ".join(SPOKEN[lang][int(d)] for d in digits)
    at, dot = AT[lang], DOT[lang]
    if kind == "email":
        name, host, top = rng.choice(["jane", "j.doe", "max-99", "info"]), rng.choice(["mail", "example", "my-host"]), rng.choice(["com", "org", "net", lang if lang != "en" else "io"])
        return rng.choice([f"{name} {at} {host} {dot} {top}", f"{name} ({at}) {host} ({dot}) {top}", f"{name}[{at}]{host}[{dot}]{top}", f"{name} {{at}} {host}.{top}", f"{name}@{host} {dot} {top}", f"{name}＠{host}．{top}", f"{name}@{host.replace('a', 'а').replace('e', 'е').replace('o', 'о')}.{top}"])
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice([f" {dot} ".join(parts), "[.]".join(parts), f"({dot})".join(parts), ".".join(parts).translate({48 + k: 0xFF10 + k for k in range(10)}), f" {dot} ".join(map(spell, parts))])
    if kind == "card":
        body = [rng.randrange(10) for _ in range(15)]
        last = next(c for c in range(10) if luhn("".join(map(str, [*body, c]))))
        digits = "".join(map(str, [*body, last]))
        groups = [digits[k : k + 4] for k in range(0, 16, 4)]
        return rng.choice([spell(digits), " ".join([*groups[:2], *map(spell, groups[2:])]), "–".join(groups), "\xa0".join(groups), digits.translate({48 + k: 0xFF10 + k for k in range(10)})])
    digits = "".join(str(rng.randrange(10)) for _ in range(10))
    plus = "más" if lang == "es" else "plus"
    return rng.choice([f"{plus} {spell('1' + digits)}", f"{plus} 1 {digits}", f"+1 {spell(digits)}", f"＋1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"+1 ({spell(digits[:3])}) {spell(digits[3:])}"])


def test_recall_of_planted_disguises():
    rng = random.Random(7)
    words = {"en": "the man said that we should call or write to", "fr": "le monsieur a dit que nous devons écrire au", "de": "der Mann sagte dass wir schreiben sollen an", "es": "el hombre dijo que debemos llamar al"}
    for kind in ("email", "ip", "card", "phone"):
        for lang in SPOKEN:
            found = 0
            for _ in range(100):
                text = f"{words[lang]}: {(it := planted(rng, kind, lang))}, {words[lang]}."
                at = text.index(it)
                found += any(k == kind and a <= at + 2 and b >= at + len(it) - 2 for k, a, b in scan(text)[1])
            assert found >= 95, (kind, lang, found)


def test_prose_has_nothing_to_add():
    for text in ("look at this point and then at that point come back", "un homme et deux femmes à ce point fr", "drei oder vier Leute um acht, null Problem", "uno dos tres, vamos a las ocho en punto", "plus one more thing. We met at 5 dot", "a-at-b look-at-me state-of-the-art", "12 point 5 percent of 3 dot 4"):
        assert scan(text)[1] == [], text


def test_very_long_texts_take_time_in_proportion():
    for text in ("7" * 2_000_000, "7." * 1_000_000, "1.2." * 500_000, "a@" * 500_000, "one " * 300_000, "12 - " * 300_000, "+1" * 500_000, "+1" + " " * 2_000_000, " at a" * 300_000, "(" * 1_000_000, "a-at-" * 200_000, "a_" * 500_000):
        began = time.perf_counter()
        scan(text)
        assert time.perf_counter() - began < 30, text[:10]
    assert scan("0" * 5000 + ".1.2.3")[0] == [("ip", 0, 5006)]


def test_contract_columns(spark):
    text = "é a@b.co 1.2.3.4 x 4242424242424242 x +1 (375) 555-4393"
    rows = {r.doc_id: r for r in personal_data(spark.createDataFrame([(1, text, "s", "n"), (2, None, "", ""), (2, None, "", "")], SCHEMA)).collect()}
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
    assert rows[1].spans == want and rows[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 1, 1)
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_and_redaction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    for r in docs.collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    df = spark.createDataFrame([(1, "a@b.co or c (at) d.org", "", ""), (2, None, "", "")], SCHEMA)
    assert {r.doc_id: r.text for r in redacted(df).collect()} == {1: "[EMAIL] or [EMAIL]", 2: None}
