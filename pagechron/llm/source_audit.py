"""How far the sources of a language part in their words: every pair, by systolic rotation."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stage

#: Documents of a language that a term must occur in.
LEAST_DOCUMENTS = 10
#: Terms of a group that are reported.
TOP = 10
UNITS = 1_000_000_000
#: Groups that stay in a task together, and terms of theirs that it looks at: together they bound its memory.
BLOCK_GROUPS = 8
SHARD_TERMS = 1 << 15
#: Terms of one group and batch that a task counts before it passes the counts on.
_HELD = 400_000
_LONG = 1 << 20
# of lower-cased UTF-8; every byte of a character beyond ASCII is one of these
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it); term '' marks that the group occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                terms = list(n)
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([seen[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
                    size += 1
                n, seen = held[lang, source]
                before, raw = len(n), text.as_py().lower()
                if len(raw) < _LONG:
                    words = _TERM.findall(raw)
                    n.update(words)
                    seen.update(set(words))
                else:  # one by one, as a list of all would be many times the text
                    own = Counter(m.group() for m in _TERM.finditer(raw))
                    n.update(own)
                    seen.update(own.keys())
                size += len(n) - before
                if size > _HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNITS * (n + 2) / (total + 2 * terms)), exact at any size of the counts; 1 without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {UNITS}) DIV CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) ELSE 1L END")


def _gap(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers up to UNITS + 1: no step leaves 64 bits."""
    return (p - q) * (p - q) // (p + q)


def visits(vectors: DataFrame) -> DataFrame:
    """Each block's rows once at home (round -1), and once for every block that it visits.

    Blocks 0 to blocks - 1 of a language play a round-robin tournament by the
    circle method: with m the odd number of places on the circle, i and j meet
    in the round r with 2r = i + j modulo m, and whoever stands in the middle
    meets i in round i. Of two that meet the lower receives the higher where
    their sum is odd, else the higher receives the lower, so that each stays
    at home in about half of its rounds.
    """
    m = "(blocks - 1 + blocks % 2)"  # with an odd number of blocks the middle is empty
    low, high = "least(block, home)", "greatest(block, home)"
    met = f"CASE WHEN block = home THEN -1L WHEN {high} = {m} THEN {low} ELSE ((block + home) * (({m} + 1) DIV 2)) % {m} END"
    receives = f"CASE WHEN (block + home) % 2 = 1 THEN {low} ELSE {high} END"
    gone = vectors.withColumn("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter(F.expr(f"home = {receives}"))
    return gone.withColumn("round", F.expr(met))


class Resident:
    """A group's shares of a shard's terms, laid open: those it has, and the one that all others get."""

    def __init__(self, row: dict):
        self.source, self.default, self.width = row["source"], row["rest"], row["width"]
        self.index, self.share = unpacked(row)
        self.at = np.full(self.width, self.default, dtype=np.int64)
        self.at[self.index] = self.share
        self.has = np.zeros(self.width, dtype=bool)
        self.has[self.index] = True

    def meet(self, index: np.ndarray, share: np.ndarray, default: int) -> int:
        """Sum of the gaps to a peer over all terms of the shard, at the cost of the terms that either has."""
        mine, both = self.at[index], self.has[index]
        total = int(_gap(mine, share).sum()) + int(_gap(self.share, default).sum()) - int(_gap(mine[both], default).sum())
        return total + (self.width - len(self.index) - len(index) + int(both.sum())) * int(_gap(self.default, default))


def packed(index: np.ndarray, share: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places as steps, and shares, both compressed."""
    return zlib.compress(np.diff(index, prepend=0).astype("<u4").tobytes(), 1), zlib.compress(share.astype("<u4").tobytes(), 1)


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    steps, share = (np.frombuffer(zlib.decompress(row[c]), dtype="<u4").astype(np.int64) for c in ("steps", "shares"))
    return np.cumsum(steps), share


def _vectors(entries: DataFrame) -> DataFrame:
    """One row for each shard and group: its packed vector, and the local heap's terms."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(head: tuple, rows: list[tuple]) -> pa.RecordBatch:
            lang, shard, block, source, blocks, width, rest = head
            own = [r for r in rows if r[0] >= 0]
            index, share, lang_share = (np.array([r[k] for r in own], dtype=np.int64) for k in range(3))
            steps, shares = packed(index, share)
            more = np.flatnonzero(share > lang_share)
            value = _gap(share[more], lang_share[more])
            # the least UTF-8 first among equals; code points and UTF-8 sort alike
            top = heapq.nsmallest(TOP, ((-v, own[k][3]) for k, v in zip(more.tolist(), value.tolist(), strict=True)))
            names = ["lang", "shard", "block", "source", "blocks", "width", "rest", "steps", "shares", "top_value", "top_term"]
            values = [lang, shard, block, source, blocks, width, rest, steps, shares, [-v for v, _ in top], [t for _, t in top]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for head, held in groupby(rows, key=lambda r: r[:7]):
            yield made(head, [r[7:] for r in held])

    head = ["lang", "shard", "block", "source", "blocks", "width", "rest"]
    dealt = entries.repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", "source", "index").select(*head, "index", "share", "lang_share", "term")
    return dealt.mapInArrow(build, "lang string, shard long, block long, source string, blocks long, width long, rest long, steps binary, shares binary, top_value array<long>, top_term array<string>")


def _rotate(vectors: DataFrame) -> DataFrame:
    """lang, source, item, value of every two groups of a language and shard, in both directions."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        for (lang, _, _), held in groupby(rows, key=lambda r: (r["lang"], r["shard"], r["home"])):
            stay: list[Resident] = []
            found: list[tuple[str, str, int]] = []
            for row in held:  # first those that live here, then the visitors, round by round
                index, share = unpacked(row)
                for one in stay:
                    value = one.meet(index, share, row["rest"])
                    found += [(one.source, row["source"], value), (row["source"], one.source, value)]
                if row["round"] < 0:
                    stay.append(Resident(row))
                if len(found) >= 8192:
                    yield out(lang, found)
                    found = []
            if found:
                yield out(lang, found)

    def out(lang: str, found: list[tuple[str, str, int]]) -> pa.RecordBatch:
        source, item, value = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(source), pa.array(item), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    sent = visits(vectors.drop("top_value", "top_term")).select("lang", "shard", "home", "round", "block", "source", "width", "rest", "steps", "shares")
    sent = sent.repartition("lang", "shard", "home").sortWithinPartitions("lang", "shard", "home", "round", "block", "source")
    return sent.mapInArrow(meet, "lang string, source string, item string, value long")


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block_groups: int = BLOCK_GROUPS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source lies from its peers, and by which terms from its language.

    The terms of a language are spread over shards by a hash, its sources over
    blocks. For each shard a block's vectors stay in a task while those of the
    other blocks come by in the rounds of a tournament, packed; a meeting gives
    both directions, and the shards' sums add up. A shard's heap keeps its best
    terms of a group, so only ``top`` of each shard meet to be ranked.

    Null text, lang and source are ''; texts without terms still make their group
    known; a language without kept terms gives 0 for all its pairs and no terms;
    one with a single source gives no pairs. Repeated rows are documents of their
    own; an empty table gives no rows; other columns are ignored.
    """
    if top > TOP:
        raise ValueError(f"heaps keep {TOP} terms")
    spark = docs.sparkSession
    prepare(spark)
    counts = stage(_counted(docs), "term-counts")
    kept = counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_documents).drop("docs")
    kept = stage(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    placed = kept.join(langs, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.expr(f"(terms + {shard_terms - 1}) DIV {shard_terms}")))
    # by shard, or the window would run on what the counts by language have left of each language in one task
    placed = placed.repartition("lang", "shard")
    placed = stage(placed.withColumn("index", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1), "placed-terms")
    widths = placed.groupBy("lang", "shard").agg(F.count("*").alias("width"))

    found = stage(counts.join(placed, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "lang_total", "shard", "index"), "group-terms")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # as many rows as there are groups
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    place, all_ = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, F.count("*").over(Window.partitionBy("lang"))
    groups = groups.withColumn("place", place).withColumn("of", all_)
    groups = groups.withColumn("block", F.expr(f"place DIV {block_groups}")).withColumn("blocks", F.expr(f"(of + {block_groups - 1}) DIV {block_groups}")).drop("place", "of")
    groups = stage(groups.withColumn("rest", _share("0L", "total", "terms")), "groups")

    head = ["lang", "shard", "block", "source", "blocks", "width", "rest"]
    # a group without any term of a shard is still a vector there
    marks = groups.join(widths, "lang", "left").select("lang", F.coalesce("shard", F.lit(0)).cast("long").alias("shard"), "block", "source", "blocks", F.coalesce("width", F.lit(0)).alias("width"), "rest", F.lit(-1).alias("index"), F.lit(None).cast("long").alias("share"), F.lit(None).cast("long").alias("lang_share"), F.lit(None).cast("string").alias("term"))
    entries = found.join(groups, ["lang", "source"]).join(widths, ["lang", "shard"])
    entries = entries.select(*head, "index", _share("n", "total", "terms").alias("share"), _share("lang_n", "lang_total", "terms").alias("lang_share"), "term")
    vectors = stage(_vectors(entries.unionByName(marks)), "group-vectors")

    pairs = _rotate(vectors).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = vectors.select("lang", "source", F.explode(F.arrays_zip("top_value", "top_term")).alias("t")).select("lang", "source", F.col("t.top_term").alias("item"), F.col("t.top_value").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def audit_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, every group against every kept term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM {table}
), t AS (SELECT lang, source, doc, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}
), l AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), g AS (SELECT DISTINCT lang, source FROM d
), m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n, l.lang_total, l.terms, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + (CAST({UNITS} AS HUGEINT) * (n + 2)) // (total + 2 * terms) AS p, 1 + (CAST({UNITS} AS HUGEINT) * (lang_n + 2)) // (lang_total + 2 * terms) AS q FROM m
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}"""
