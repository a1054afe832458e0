"""Tokenisers and text measures as Column expressions. Each consumer has its own token class and stop list; they differ on purpose."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list and token class of each consumer.
_BASE = "a an the of to in for on at by with from is are was were be been being and or as that this it its"
_ASKING = "what which who when where why how do does did can could should would must"
RERANK_STOP = f"{_BASE} {_ASKING}".split()
PACK_STOP = (
    "a an the of to in for on at by with from is are was were be been being do does did what which who whom whose when where why how and or if then than "
    "that this these those i you we they it its as can could should would may might must our your their"
).split()
GROUNDING_STOP = f"{_BASE} there here also then thus so we you they".split()
ANSWER_STOP = RERANK_STOP
STANCE_STOP = f"{_BASE} there".split()
PARAMETRIC_STOP = f"{_BASE} {_ASKING} will about tell me please our your".split()
MEMORY_STOP = "a an the of to in for on at by with from is are was were be and or as that this it what which who how do does did i we you my our me us".split()
NEGATIONS = ["not", "never", "no", "cannot", "without"]

LEXICAL = r"[a-z0-9][a-z0-9\-_.]*"
CLAIM = r"[a-z0-9][a-z0-9\-_.%/]*"
STANCE = r"[a-z0-9][a-z0-9\-.]*"
PLAIN = r"[a-z0-9][a-z0-9\-]*"
STEM = 5


def tokens(text: Column, pattern: str = LEXICAL) -> Column:
    """Tokens of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


_LEXICAL_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789-_."
_BETWEEN = bytes(c if c in _LEXICAL_BYTES else 32 for c in bytes(range(256)).lower())
#: What lower() makes ASCII of besides A-Z, in UTF-8.
_TO_ASCII = [(c.encode(), c.lower().encode()) for c in "\u0130\u212a"]


def lexical_counts(utf8: bytes) -> Counter:
    """How often each token of LEXICAL is in a text, lower-cased, all in UTF-8: of each run of a token's characters what
    follows the leading ones that begin none."""
    for letter, low in _TO_ASCII:
        if letter in utf8:
            utf8 = utf8.replace(letter, low)
    found = Counter(utf8.translate(_BETWEEN).split())
    for run in [r for r in found if r[0] in b"-_."]:
        n, token = found.pop(run), run.lstrip(b"-_.")
        if token:
            found[token] += n
    return found


def content(text: Column, pattern: str, stop: list[str], least: int = 1) -> Column:
    """The set of tokens of at least `least` characters outside the stop list."""
    stops = F.array(*[F.lit(w) for w in stop])
    return F.array_distinct(F.filter(tokens(text, pattern), lambda t: (F.length(t) >= least) & ~F.array_contains(stops, t)))


def with_stems(words: Column, size: int = STEM) -> Column:
    """Words, each longer one with its stem."""
    stems = F.transform(F.filter(words, lambda w: F.length(w) > size), lambda w: F.substring(w, 1, size))
    return F.array_distinct(F.concat(words, stems))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def covered(a: Column, b: Column) -> Column:
    """Share of a's members that are in b; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: plain characters by 4, dense ones by 2.8, rounded half to even, 1 at least, 0 for an empty text."""
    dense = F.length(F.regexp_replace(text, "[A-Za-z0-9\\s&&[^\\u3000-\\u9fff]]", ""))
    n = F.length(text)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround((n - dense) / 4.0 + dense / 2.8))).cast("long")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(collapsed(text), 256))


def normalized(text: Column) -> Column:
    """Lower case, punctuation to space, white space collapsed: what near-duplicate fingerprints are taken of."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def words_of(text: Column) -> Column:
    """The set of words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda w: w != ""))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
