"""From raw texts to blocks, chunks and vectors.

Markdown and plain text become blocks in DataFrame operations: lines are classified on their own, fences and paragraphs
are running counts, and a block's heading path is the last heading of each level that no higher heading has closed since.
HTML needs a parser, and chunking packs greedily, so these run in Arrow batches, one document at a time.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.functions import text
from querent.operators.guardrails import BOILERPLATE
from querent.sources.shared import spread

#: The patterns of lines.
FENCE, HEADING, LIST_ITEM, QUOTE = r"^\s*```", r"^(#{1,6})\s+(.*)$", r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$", r"^\s*>\s?(.*)$"
TABLE_ROW, TABLE_DIVIDER = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:|-]+\|\s*$"
CLAUSE = r"^\s*(?:section|article|clause)?\s*\d+(?:\.\d+)*\.?\s+\S"
SPEAKER = r"^\s*(?:\[[\d:.\s]+\]\s*)?([A-Z][\w .'-]{1,40}):\s+\S"
LEVELS = range(1, 7)
TARGET, MOST, LEAST_SECTION, MOST_PARENT, LEAST_CHUNK = 400, 800, 120, 2000, 12
RECURSIVE_TARGET, OVERLAP = 512, 0.15
#: Separators, the coarsest first; HTML tags that make blocks, and those that are skipped.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
BLOCK_TAGS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "code", "td": "table_row", "th": "table_header"} | {f"h{k}": "heading" for k in LEVELS}
SKIPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside"}
UNSPLITTABLE = {"code", "table_row", "table_header", "clause"}
BLOCKS = "doc_id long, block_no int, kind string, level int, text string, heading_path array<string>"


def with_heading_paths(blocks: DataFrame) -> DataFrame:
    """Adds heading_path to rows of doc_id, block_no, kind, level and text."""
    before = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.struct("block_no", "text"))).over(before) for k in LEVELS}
    rows = blocks.select("*", *[c.alias(f"h{k}") for k, c in last.items()])
    own = F.when(F.col("kind") == "heading", F.col("level")).otherwise(7)
    path = []
    for k in LEVELS:
        open_ = F.col(f"h{k}").isNotNull() & (F.lit(k) < own)
        for j in range(1, k):
            open_ = open_ & F.coalesce(F.col(f"h{j}.block_no") < F.col(f"h{k}.block_no"), F.lit(True))
        path.append(F.when(open_, F.col(f"h{k}.text")))
    return rows.withColumn("heading_path", F.array_compact(F.array(*path))).drop(*[f"h{k}" for k in LEVELS])


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of Markdown texts (doc_id, text)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "line"))
    line = F.col("line")
    by_line = Window.partitionBy("doc_id").orderBy("n")
    fences = F.sum(line.rlike(FENCE).cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("fences", F.coalesce(fences, F.lit(0))).withColumn("fence", line.rlike(FENCE))
    coded = F.col("fence") | (F.col("fences") % 2 == 1)
    kind = (
        F.when(coded, "code")
        .when(line.rlike(HEADING), "heading")
        .when(F.trim(F.regexp_replace(line, r"\s", "")) == "", "blank")
        .when(line.rlike(TABLE_DIVIDER), "divider")
        .when(line.rlike(TABLE_ROW), "table_header")
        .when(line.rlike(QUOTE), "quote")
        .when(line.rlike(LIST_ITEM), "list_item")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind).where("kind <> 'divider'")
    breaks = F.sum((F.col("kind") != "paragraph").cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    # lines of one fence share a number; so do paragraph lines with nothing else between them
    pair = F.floor((F.col("fences") + F.when(F.col("fences") % 2 == 0, 1).otherwise(0) + 1) / 2)
    group = F.when(F.col("kind") == "code", F.concat(F.lit("c"), pair)).when(F.col("kind") == "paragraph", F.concat(F.lit("p"), breaks)).otherwise(F.concat(F.lit("l"), "n"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", HEADING, 1)))
    said = (
        F.when(F.col("kind") == "heading", F.trim(F.regexp_extract("line", HEADING, 2)))
        .when(F.col("kind") == "quote", F.regexp_extract("line", QUOTE, 1))
        .when(F.col("kind") == "list_item", F.regexp_extract("line", LIST_ITEM, 1))
        .when(F.col("kind") == "code", line)
        .otherwise(F.regexp_replace(line, r"^\s+|\s+$", ""))
    )
    rows = lines.withColumn("group", group).where("kind <> 'blank'").withColumn("level", level).withColumn("said", said)
    made = rows.groupBy("doc_id", "kind", "group").agg(
        F.min("n").alias("n"),
        F.max("level").alias("level"),
        F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("n", "said"))))["said"].alias("parts"),
        F.count_if("fence").alias("marks"),
    )
    body = F.array_join("parts", "\n")
    made = made.withColumn("text", F.when(F.col("kind") == "code", body).otherwise(F.array_join("parts", " ")))
    made = made.where((F.col("kind") != "code") | (F.col("marks") == 2) | (F.size("parts") > 0))
    made = made.withColumn("kind", F.when((F.col("kind") == "paragraph") & F.col("text").rlike(CLAUSE), "clause").otherwise(F.col("kind")))
    made = made.withColumn("block_no", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).cast("int"))
    return with_heading_paths(made.select("doc_id", "block_no", "kind", "level", "text"))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of plain texts: parts between blank lines."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("block_no", "text"))
    kind = F.when(F.col("text").rlike(SPEAKER), "speaker_turn").when(F.col("text").rlike(CLAUSE), "clause").otherwise("paragraph")
    return rows.select("doc_id", "block_no", kind.alias("kind"), F.lit(None).cast("int").alias("level"), "text", F.array().cast("array<string>").alias("heading_path"))


class _Blocks(HTMLParser):
    """Texts of block tags outside skipped ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.parts, self.skipping = [], None, [], 0

    def end_block(self):
        said = " ".join("".join(self.parts).split())
        if self.open and said:
            self.found.append((BLOCK_TAGS[self.open], int(self.open[1]) if BLOCK_TAGS[self.open] == "heading" else None, said))
        self.open, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skipping += 1
        elif not self.skipping and tag in BLOCK_TAGS:
            self.end_block()
            self.open = tag

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping and tag in BLOCK_TAGS:
            self.end_block()

    def handle_data(self, data):
        if self.open and not self.skipping:
            self.parts.append(data)


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages (doc_id, html); text outside block tags is left out."""

    def parse(batches):
        clause = re.compile(CLAUSE)
        for batch in batches:
            rows = []
            for doc_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = _Blocks()
                p.feed(html or "")
                p.close()
                p.end_block()
                rows += [(doc_id, k, "clause" if kind != "heading" and clause.match(said) else kind, level, said) for k, (kind, level, said) in enumerate(p.found)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "block_no", "kind", "level", "text"])

    return with_heading_paths(spread(pages.select("doc_id", "html")).mapInArrow(parse, "doc_id long, block_no int, kind string, level int, text string"))


def document_types(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Type and heading count of every document; the first share that is reached decides."""
    share = lambda *kinds: F.count_if(F.col("kind").isin(*kinds)) / F.count(F.lit(1))
    heads = F.count_if(F.col("kind") == "heading")
    kind = (
        F.when(share("clause") >= 0.30, "legal_or_policy")
        .when(share("speaker_turn") >= 0.40, "transcript")
        .when(share("table_row", "table_header") >= 0.50, "tabular")
        .when(share("code") >= 0.50, "code")
        .when(heads >= 2, "structured_prose")
        .otherwise("unstructured_prose")
    )
    found = blocks.groupBy("doc_id").agg(kind.alias("doc_type"), heads.alias("headings"), F.count(F.lit(1)).alias("blocks"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("doc_type", F.lit("degraded")).alias("doc_type"), F.coalesce("headings", F.lit(0)).alias("headings"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def chunk_strategy(doc_type: Column, headings: Column) -> Column:
    """Only structured prose with a hierarchy is chunked by structure; there is no other strategy than these two."""
    return F.when((doc_type == "structured_prose") & (headings >= 2), "structure_aware").otherwise("recursive_character")


_PLAIN = re.compile(r"[A-Za-z0-9]+|[^\S　-鿿]")


def _weight(said: str) -> tuple[int, int]:
    """Plain and dense characters; weights of parts add up to that of the whole."""
    dense = len(_PLAIN.sub("", said))
    return len(said) - dense, dense


def _estimate(plain: int, dense: int) -> int:
    return max(1, round(plain / 4.0 + dense / 2.8)) if plain + dense else 0


def tokens_in(said: str) -> int:
    """The token estimate of functions.text, for use inside Python tasks."""
    return _estimate(*_weight(said))


def _filled(parts, limit, glue):
    """Greedy runs of parts whose estimates stay within a limit; a part over it is a run of its own."""
    run, size = [], 0
    for part in parts:
        n = tokens_in(part)
        if run and size + n > limit:
            yield glue.join(run)
            run, size = [], 0
        run.append(part)
        size += n
    if run:
        yield glue.join(run)


def sections_of(blocks: list[dict], least: int) -> list[list[dict]]:
    """Runs of blocks that begin at headings; a run that is too small goes to the next, the last to the one before."""
    starts = [k for k, b in enumerate(blocks) if b["kind"] == "heading" or k == 0]
    out, held = [], []
    for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
        held = held + blocks[a:b]
        if tokens_in("\n\n".join(x["text"] for x in held)) >= least:
            out.append(held)
            held = []
    if held:
        out[-1:] = [out[-1] + held] if out else [held]
    return out


def children_of(section: list[dict], target: int, most: int) -> list[str]:
    """Texts of about `target` tokens from a section; a heading never stands alone."""
    out, texts, size, said = [], [], 0, False
    for b in section:
        n = tokens_in(b["text"])
        if n > most:
            parts = [b["text"]] if b["kind"] in UNSPLITTABLE else list(_filled(re.split(r"(?<=[.!?])\s+", b["text"]), target, " "))
            if said:
                out.append("\n\n".join(texts))
            else:
                parts[0] = "\n\n".join([*texts, parts[0]])
            out += parts
            texts, size, said = [], 0, False
            continue
        if said and size + n > target:
            out.append("\n\n".join(texts))
            texts, size, said = [], 0, False
        texts.append(b["text"])
        size += n
        said = said or b["kind"] != "heading"
    rest = "\n\n".join(texts)
    if said:
        out.append(rest)
    elif texts and out:
        out[-1] += "\n\n" + rest
    return [c for c in out if c.strip()]


def structure_chunks(blocks: DataFrame, target: int = TARGET, most: int = MOST, least_section: int = LEAST_SECTION, most_parent: int = MOST_PARENT) -> DataFrame:
    """Chunks of documents with headings: doc_id, chunk_no, text, parent_text (null where equal), heading_path, tokens."""
    row = F.struct("block_no", "kind", "text", "heading_path")
    docs = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("blocks"))

    def chunk(batches):
        for batch in batches:
            rows = []
            for doc_id, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for section in sections_of(items, least_section):
                    parent = "\n\n".join(b["text"] for b in section)
                    if tokens_in(parent) > most_parent:
                        parent = parent[: most_parent * 4].rsplit(" ", 1)[0] + " […]"
                    path = next(([*b["heading_path"], b["text"]] for b in section if b["kind"] == "heading"), section[0]["heading_path"])
                    for child in children_of(section, target, most):
                        rows.append((doc_id, n, child, parent if parent != child else None, path, tokens_in(child)))
                        n += 1
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "chunk_no", "text", "parent_text", "heading_path", "tokens"])

    return docs.mapInArrow(chunk, "doc_id long, chunk_no int, text string, parent_text string, heading_path array<string>, tokens long")


def cut_text(said: str, target: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most `target` tokens, cut at the coarsest separator that is there, then at finer ones."""
    if tokens_in(said) <= target:
        return [said] if said.strip() else []
    at = next((k for k, s in enumerate(separators) if s in said), None)
    if at is None:
        return [p for k in range(0, len(said), target * 4) if (p := said[k : k + target * 4]).strip()]
    glue, out, run, weight = separators[at], [], [], (0, 0)
    between = _weight(glue)

    def close():
        # a run that is one part too long has none of this separator left, so it is cut at a finer one
        out.extend(cut_text(glue.join(run), target, separators))

    for part in said.split(glue):
        own = _weight(part)
        grown = (weight[0] + between[0] + own[0], weight[1] + between[1] + own[1]) if sum(weight) else own
        if sum(weight) and _estimate(*grown) > target:
            close()
            run, grown = [], own
        if sum(weight) == 0:
            run = []  # parts before the first that isn't empty leave no trace
        run.append(part)
        weight = grown
    if sum(weight):
        close()
    return [p for p in out if p.strip()]


def recursive_chunks(docs: DataFrame, target: int = RECURSIVE_TARGET, overlap: float = OVERLAP) -> DataFrame:
    """Chunks of any text; each but the first begins with the end of the one before."""
    if not 0 <= overlap < 0.5:
        raise ValueError("overlap must be at least 0 and under 0.5")
    tail = int(target * overlap) * 4

    def chunk(batches):
        for batch in batches:
            rows = []
            for doc_id, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = cut_text(said or "", target)
                ends = ["", *((p[-tail:].lstrip() if tail else "") for p in pieces[:-1])]
                rows += [(doc_id, k, c, tokens_in(c)) for k, c in enumerate(f"{e} {p}" if e else p for e, p in zip(ends, pieces, strict=False))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["doc_id", "chunk_no", "text", "tokens"])

    return spread(docs.select("doc_id", "text")).mapInArrow(chunk, "doc_id long, chunk_no int, text string, tokens long")


def rejection(said: Column, least: int = LEAST_CHUNK) -> Column:
    """Why a chunk is rejected; null where it is kept."""
    return F.when(F.trim(said) == "", "empty").when(text.token_estimate(said) < least, "too_short").when(said.rlike(f"(?i){BOILERPLATE}"), "boilerplate")


def prefixed(said: Column, path: Column) -> Column:
    """What is embedded: the heading trail and the text."""
    return F.when(F.size(path) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"), said)).otherwise(said)


def hashed_vectors(rows: DataFrame, dims: int = 256, purpose: str = "document") -> DataFrame:
    """Signed hashing of tokens and their 4-grams into `dims` buckets, normalised; rows have doc_id and text."""
    word = re.compile(text.LEXICAL)

    def bucket(token: str) -> tuple[int, float]:
        value = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        return value % dims, 1.0 if value >> 63 else -1.0

    def embed(batches):
        known: dict[str, np.ndarray] = {}

        def token_vector(token):
            if token not in known:
                if len(known) > 20_000:
                    known.clear()
                v = np.zeros(dims)
                grams = [token[k : k + 4] for k in range(len(token) - 3)] if len(token) >= 5 else []
                for t, w in [(token, 1.0), *((g, 0.35) for g in grams)]:
                    k, sign = bucket(t)
                    v[k] += sign * w
                known[token] = v
            return known[token]

        mark, sign = bucket(f"__{purpose}__")
        for batch in batches:
            out = []
            for said in batch.column(1).to_pylist():
                v = np.zeros(dims)
                for token in word.findall((said or "").lower()):
                    v += token_vector(token)
                v[mark] += sign * 0.1
                norm = float(np.sqrt((v * v).sum()))
                out.append((v / norm if norm else v).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["doc_id", "vector"])

    return spread(rows.select("doc_id", "text")).mapInArrow(embed, "doc_id long, vector array<double>")


# The fields of an index entry, in order, and what a reader takes where one is missing.
PAYLOAD = (
    "chunk_id document_id document_version tenant_id source_id text parent_text parent_id heading_path order strategy token_estimate acl_hash authority volatility_class "
    "lineage_root embedding_version"
).split()
_READ = {"chunk_id": "", "document_id": "", "document_version": "unknown", "text": "", "parent_text": None, "heading_path": [], "acl_hash": "public", "tenant_id": None, "authority": 0.5, "lineage_root": None, "embedding_version": None}
_KINDS = {"heading_path": "array<string>", "authority": "double", "order": "int", "token_estimate": "long"}


def payload(chunks: DataFrame, embedding_version: str) -> DataFrame:
    """What the index keeps of each chunk: PAYLOAD. Columns that the chunks lack are null; a chunk without a lineage is its
    document's."""
    rows = chunks.withColumn("embedding_version", F.lit(embedding_version))
    for name in PAYLOAD:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(_KINDS.get(name, "string")))
    root = F.coalesce(F.nullif(F.col("lineage_root").cast("string"), F.lit("")), F.col("document_id").cast("string"))
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    return rows.withColumns({"lineage_root": root, "heading_path": path}).select(*PAYLOAD)


def payload_fields(rows: DataFrame) -> DataFrame:
    """Reads entries that an older writer may have made: missing columns, and nulls of a field that has a default, get it.
    Further columns are left out."""

    def field(name, default):
        have = F.col(name) if name in rows.columns else F.lit(None)
        kind = _KINDS.get(name, "string")
        empty = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        return F.coalesce(have.cast(kind), empty)

    cols = {n: field(n, d) for n, d in _READ.items()}
    cols["lineage_root"] = F.coalesce(F.nullif(cols["lineage_root"], F.lit("")), cols["document_id"])
    return rows.select(*[c.alias(n) for n, c in cols.items()])


#: Fields that come from the writer, not from the chunk: a change of these alone is a change too.
_HASHED = [n for n in PAYLOAD if n != "chunk_id"]


def entry_hash(rows: DataFrame) -> DataFrame:
    """chunk_id, document_id and the digest of everything that an entry holds."""
    return rows.select("chunk_id", "document_id", F.sha2(F.to_json(F.struct(*_HASHED), {"ignoreNullFields": "false"}), 256).alias("entry_hash"))


def changes(before: DataFrame, after: DataFrame, whole: bool = False) -> DataFrame:
    """chunk_id and change of each entry between two snapshots (chunk_id, document_id, entry_hash): `added`, `changed`,
    `unchanged`, or `removed`: an entry whose document is in the new snapshot without it, as the document got shorter. With
    `whole` the new snapshot is the whole corpus, and entries of documents that it lacks are removed as well. Without it
    such entries are not mentioned. One shuffle by chunk_id; documents meet by a semi join. Null ids match each other;
    of repeated entries of one id the one of the greatest digest counts."""
    one = lambda rows, name: rows.groupBy("chunk_id").agg(F.max(F.struct("entry_hash", "document_id")).alias(name))
    a, b = one(before, "old").withColumnRenamed("chunk_id", "_id"), one(after, "new")
    rows = b.join(a, F.col("chunk_id").eqNullSafe(F.col("_id")), "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old.entry_hash") == F.col("new.entry_hash"), "unchanged").otherwise("changed")
    rows = rows.select(F.when(F.col("new").isNull(), F.col("_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), change.alias("change"), F.col("old.document_id").alias("document_id"))
    if not whole:
        there = after.select(F.col("document_id").alias("_document")).distinct()
        gone = rows.where("change = 'removed'").join(there, F.col("document_id").eqNullSafe(F.col("_document")), "left_semi")
        rows = rows.where("change <> 'removed'").unionByName(gone)
    return rows.select("chunk_id", "change")
