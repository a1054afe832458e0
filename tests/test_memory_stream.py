"""Memory as the state of a stream, against a plain list for each principal."""

import json
import random
import re

import pytest

from querent.functions import text
from querent.plans import streaming as plans
from querent.sources.catalog import CLOCK_MS, DAY_MS
from querent.streaming import events as ev
from querent.streaming import memory as m

NAMES = [c.split()[0] for c in m.EVENT.split(", ")]


def words(body):
    return {w for w in re.findall(text.PLAIN, (body or "").lower()) if len(w) >= 2 and w not in text.MEMORY_STOP}


def brute(events, store):
    stores, out = {}, []
    for e in sorted(events, key=lambda e: (str(e["principal"]), e["at_ms"], e["event_id"])):
        items, now = stores.setdefault(e["principal"], []), e["at_ms"]
        if store.ttl_ms is not None:
            items[:] = [i for i in items if i["created"] >= now - store.ttl_ms]
        worth = lambda i: i["salience"] if not store.half_life_days else i["salience"] * 0.5 ** (max(0, now - max(i["created"], i["used"] or 0)) / DAY_MS / store.half_life_days)
        outcome, ids = None, []
        if e["kind"] == "write":
            fact = " ".join((e["text"] or "").lower().split())
            same = [i for i in items if i["fact"] == fact]
            if e["namespace"] != store.namespace:
                outcome = "refused_namespace"
            elif store.namespace == "long_term" and e["provenance"] not in ("user_asserted", "confirmed_structured"):
                outcome = "refused_provenance"
            elif store.namespace == "long_term" and same:
                same[0].update(salience=max(same[0]["salience"], e["salience"]), used=now)
                outcome = "merged"
            else:
                items.append({"id": e["item_id"], "fact": fact, "words": words(e["text"]), "salience": e["salience"], "created": now, "used": None, "session": e["session_id"], "provenance": e["provenance"]})
                outcome = "written"
                if store.capacity and len(items) > store.capacity:
                    worst = min(items, key=lambda i: (worth(i), i["created"]))
                    items.remove(worst)
                    ids = [worst["id"]]
            n = len(items)
        elif e["kind"] == "read":
            found = [i for i in items if e["session_id"] is None or i["session"] == e["session_id"]]
            if store.window:
                found = [i for k, i in enumerate(found) if sum(j["session"] == i["session"] for j in found[k + 1 :]) < store.window]
            asked = words(e["text"])
            rated = [(len(asked & i["words"]) / len(asked) if asked else 0.0, worth(i), i["created"], i) for i in found]
            rated = [r for r in rated if store.namespace == "session" or not asked or r[0]]
            rated.sort(key=lambda r: r[:3], reverse=True)
            best = [r[3] for r in rated[: e["most"]]]
            if store.half_life_days:
                for i in best:
                    i["used"] = now
            outcome, ids, n = "read", [i["id"] for i in best], len(items)
        else:
            wanted = {"id": e["item_id"], "session": e["session_id"], "provenance": e["provenance"]}
            given = {k: v for k, v in wanted.items() if v is not None}
            hit = lambda i: all(i[k] == v for k, v in given.items()) and (e["before_ms"] is None or i["created"] < e["before_ms"]) and (e["namespace"] in (None, store.namespace))
            some = bool(given) or e["before_ms"] is not None or e["namespace"] is not None
            gone = [i for i in items if some and hit(i)]
            items[:] = [i for i in items if i not in gone]
            outcome, n = "forgotten", len(gone)
        out.append((e["principal"], e["event_id"], e["kind"], outcome, ids, n))
    return sorted(out, key=repr)


def random_events(seed, n, store):
    rng = random.Random(seed)
    texts = ["I like green tea", "i  LIKE green tea", "My server is in Oslo", "Tea is cold", "The rota is weekly", "x", None, "Backups run nightly in Oslo"]
    out = []
    for k in range(n):
        kind = rng.choices(["write", "read", "forget"], [6, 4, 1])[0]
        e = dict.fromkeys(NAMES) | {"principal": rng.choice(["a", "b", None]), "event_id": k, "at_ms": CLOCK_MS + k * 600_000, "kind": kind, "item_id": f"i{k}", "salience": rng.choice([0.2, 0.5, 0.9]), "most": rng.choice([1, 3])}
        e |= {"text": rng.choice(texts), "session_id": rng.choice([None, "s1", "s2"])}
        if kind == "write":
            e |= {"namespace": rng.choice([store.namespace] * 6 + ["other"]), "provenance": rng.choice(["user_asserted", "confirmed_structured", "model_generated"])}
        if kind == "forget":
            e |= {"item_id": None, "namespace": None, "session_id": rng.choice([None, "s1"]), "before_ms": rng.choice([None, CLOCK_MS + k * 300_000]), "text": None}
        out.append(e)
    return out


def run(spark, tmp_path, events, store, files):
    """The events in as many triggers as files."""
    old = spark.conf.get(m._PROVIDER)
    folder, rows = tmp_path / "in", []
    folder.mkdir()
    stream = spark.readStream.schema(m.EVENT).option("maxFilesPerTrigger", 1).json(str(folder))
    query = lambda: ev.run_to_table(m.remembered(stream, store), str(tmp_path / "out"))
    size = -(-len(events) // files)
    try:
        for k in range(files):
            (folder / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[k * size : (k + 1) * size]))
            rows = query()
        return sorted(((r.principal, r.event_id, r.kind, r.outcome, list(r.item_ids), r.n) for r in rows.collect()), key=repr)
    finally:
        spark.conf.set(m._PROVIDER, old)


@pytest.mark.parametrize("store", [m.Store("long_term", capacity=3, half_life_days=0.05), m.Store("session", ttl_ms=5 * 3_600_000, window=2)])
def test_matches_a_plain_list(spark, tmp_path, store):
    events = random_events(3, 120, store)
    assert run(spark, tmp_path, events, store, 3) == brute(events, store)


def test_turns_of_conversations(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "My server is in Oslo."), (1, 1, "assistant", "Noted."), (1, 2, "user", "Where is the server?"), (1, 3, "user", "my SERVER is in oslo."), (2, 0, "user", "Where is the server?")], "conv_id long, turn long, role string, text string")
    events = [r.asDict() for r in plans.memory_events(turns).collect()]
    got = {(r[0], r[1] % 100_000): r[3:] for r in run(spark, tmp_path, events, m.LONG_TERM, 1)}
    assert got["1", 1] == ("written", [], 1) and got["1", 3] == ("refused_provenance", [], 1)
    assert got["1", 4] == ("read", ["1:0"], 1) and got["1", 7] == ("merged", [], 2) and got["2", 0] == ("read", [], 0)
