import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from querent.llm.packing import pack, pack_documents, plan_bins

SCHEMA = "doc_id long, text string, length long, _rank string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_packs_each_length_once_and_never_overfills(lengths):
    bins = plan_bins(Counter(lengths), 50)
    assert all(sum(b) <= 50 for b, _ in bins)
    assert Counter(x for b, n in bins for x in b * n) == Counter(lengths)


def test_two_shorter_pieces_replace_the_smallest_where_tighter():
    assert plan_bins({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0] == ([60, 21, 19], 1)


def check(rows, texts):
    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(want)
    for d, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d]) and all(r.length == 2048 for r in pieces[1:])
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), sum(map(len, want.values()))


def test_pack_documents_matches_the_tokenizer(spark):
    texts = {i: f"some words {i} " * (i % 70) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "x <|endoftext|> y", 1003: "漢字かな 😀 Ω" * 50, 1004: "don't  stop \n\n we'll\xa0go on " * 900, 1005: "é" * 9000}
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in texts.items()], SCHEMA)
    used, tokens = check(pack_documents(df).collect(), texts)
    assert used <= -(-tokens // 2048) + 1


def test_empty_and_repeated(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = pack_documents(spark.createDataFrame([(5, "same text", 1, "")] * 3, SCHEMA)).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_hot_length_is_ranked_in_parts(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 700, id % 90 + 1) as long) as length")
    rows = pack(df).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 5000
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
