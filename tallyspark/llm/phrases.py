"""Phrase collocation mining by hierarchical pair naming.

A task cuts its texts into words and keeps, for units of some megabytes of one language, the sequence of words as
codes of the unit's own dictionary. What is counted globally are the dictionary's entries, not the occurrences: one
row for each word and unit. Words that are frequent get an id; a frequent phrase of k words is named as the pair of the ids of
its first and its last k - 1 words. So in each round the units replace adjacent ids by the pairs that they form, the
pairs are counted and named in one grouping over all units (the name is the first place that holds the pair), and the names
go back to the units, where they are the symbols of the next round. A phrase is no more frequent than its parts, so pairs of
frequent ids are all that is needed, and nothing is lost.

A pair's two ids are parent pointers: following them gives the frequencies of all first and last parts (the cuts),
and since frequency only falls with length, a phrase lies in a longer one of at least 80 % of its frequency just if it is a
parent of such a phrase one word longer.

A null text has no words; a null lang is `und`, and counts together with that; a null or repeated doc_id does not matter,
repeated rows count repeatedly; other columns are ignored; empty tables and texts without words give no row. Long
texts are not cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import UPPER, Workspace, forget_shuffles, small, table

LEAST, LONGEST, TOP = 30, 4, 2000
#: Bytes of text of a unit: larger ones repeat fewer entries between units, and a task holds a few of them.
UNIT_BYTES = 6 << 20
#: Passes in which the pairs of a round are counted: what a pass shuffles is gone before the next one.
PASSES = 3
#: Rows that leave a task at a time.
SLICE = 1 << 16
#: Parts in which a language's best phrases are found before its ranks are given.
PARTS = 64
MIX = np.uint64(0x9E3779B97F4A7C15)
BREAKS = b".,;:!?\x0b\x0c\r"
BYTES = bytes.maketrans(UPPER.encode() + BREAKS + b"\t", UPPER.lower().encode() + b"\n" * len(BREAKS) + b" ")
UNIT = "unit long, lang string, n long, words array<string>, counts array<long>, codes binary"
SEQUENCE = "unit long, codes binary, ids array<long>"
#: A place is a unit and the number of an entry in it: bits of the tasks, of the units of a task, and of the entries.
TASK_BITS, MADE_BITS, ENTRY_BITS = 20, 16, 27


def packed(codes: np.ndarray) -> bytes:
    """Codes as compressed planes of bytes, after their number."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return np.int64(len(codes)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    buffer = value.as_buffer()
    n = int(np.frombuffer(buffer, dtype=np.int64, count=1)[0])
    planes = np.frombuffer(pa.decompress(buffer.slice(8), decompressed_size=4 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").reshape(n).astype(np.int64)


def compact(codes: np.ndarray) -> np.ndarray:
    """Codes in which -1 separates: a separator once, and no code that has no neighbour."""
    n = len(codes)
    there = codes >= 0
    near = np.zeros(n, dtype=bool)
    near[1:] |= there[:-1]
    near[:-1] |= there[1:]
    out = np.where(there & near, codes, -1)
    keep = out >= 0
    keep[1:] |= out[:-1] >= 0
    return out[keep].astype(np.int32)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(dictionary, codes): the words of the texts, -1 between pieces. All bytes that cut are ASCII."""
    blob = b"\n".join(texts).translate(BYTES).replace(b"\n", b" \n ")
    coded = pc.list_flatten(pc.split_pattern(pa.array([blob], pa.large_binary()), pattern=b" ")).dictionary_encode()
    codes, entries = coded.indices.to_numpy(), coded.dictionary
    empty, separator = (pc.index(entries, pa.scalar(x, pa.large_binary())).as_py() for x in (b"", b"\n"))
    word = np.ones(len(entries), dtype=bool)
    word[[k for k in (empty, separator) if k >= 0]] = False
    name = np.cumsum(word) - 1
    name[~word] = -1
    return entries.filter(pa.array(word)).cast(pa.large_string()), name[codes[codes != empty]]


def cut_units(batches: Iterator[pa.RecordBatch], most: int = UNIT_BYTES) -> Iterator[pa.RecordBatch]:
    """Units of one language from the texts of a task."""
    task, made = TaskContext.get(), 0
    part = task.partitionId() if task else 0
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def unit(lang: str) -> pa.RecordBatch:
        nonlocal made
        entries, codes = words_of(held.pop(lang))
        sizes.pop(lang)
        made += 1
        if part >> TASK_BITS or made >> MADE_BITS or len(entries) >> ENTRY_BITS:
            raise ValueError("more tasks, units of a task or words of a unit than a place can name")
        counts = np.bincount(codes[codes >= 0], minlength=len(entries))
        one = [pa.array([part << MADE_BITS | made], pa.int64()), pa.array([lang], pa.string()), pa.array([int(counts.sum())], pa.int64())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (entries.cast(pa.string()), pa.array(counts, pa.int64()))]
        return pa.RecordBatch.from_arrays([*one, *lists, pa.array([packed(compact(codes))], pa.binary())], ["unit", "lang", "n", "words", "counts", "codes"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= most:
                yield unit(lang)
            elif sum(sizes.values()) >= 2 * most:
                yield unit(max(sizes, key=sizes.__getitem__))
    for lang in list(held):
        yield unit(lang)


def pair_keys(c: np.ndarray) -> np.ndarray:
    """Adjacent symbols as one number, -1 where one of them separates."""
    return np.where((c[:-1] >= 0) & (c[1:] >= 0), c[:-1] << 32 | c[1:], -1)


def pairs_of(turn: int, passes: int):
    """Function of a task: (place, first, last, n) of each pair of adjacent symbols of a unit, once; the pairs that are
    dealt to a pass by their names. A place numbers all pairs of its unit, in the order of pair_keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, codes, ids in zip(batch.column("unit").to_pylist(), batch.column("codes"), batch.column("ids"), strict=True):
                keys = pair_keys(unpacked(codes))
                key, n = np.unique(keys[keys >= 0], return_counts=True)
                del keys
                if len(key) >> ENTRY_BITS:
                    raise ValueError("more pairs of a unit than a place can name")
                names = ids.values.to_numpy()
                for k in range(0, len(key), SLICE):
                    part = key[k : k + SLICE]
                    first, last = names[part >> 32], names[part & 0xFFFFFFFF]
                    with np.errstate(over="ignore"):
                        dealt = (first.astype(np.uint64) * MIX + last.astype(np.uint64)) * MIX >> np.uint64(40)
                    mine = np.flatnonzero(dealt % np.uint64(passes) == turn)
                    columns = [(unit << ENTRY_BITS) + k + mine, first[mine], last[mine], n[k : k + SLICE][mine]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["place", "first", "last", "n"])

    return run


def renamed(pairs: bool):
    """Function of a unit: its symbols (or pairs of them) by their names; what has none separates."""

    def run(sequence: pa.Table, names: pa.Table) -> pa.Table:
        kind = pa.schema([("unit", pa.int64()), ("codes", pa.binary()), ("ids", pa.list_(pa.int64()))])
        if not sequence.num_rows or not names.num_rows:
            return kind.empty_table()
        c = unpacked(sequence.column("codes")[0])
        if pairs:
            keys = pair_keys(c)
            there = keys >= 0
            c = np.full(len(keys), -1)
            c[there] = np.unique(keys[there], return_inverse=True)[1]
        entry, ids = names.column("entry").to_numpy(), names.column("id").to_numpy()
        new = np.full(max(int(c.max(initial=-1)), int(entry.max())) + 2, -1)  # its last one stands for -1
        new[entry] = np.arange(len(entry))
        codes = compact(new[c])
        if not len(codes):
            return kind.empty_table()
        return pa.table([pa.array([sequence.column("unit")[0].as_py()], pa.int64()), pa.array([packed(codes)], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], schema=kind)

    return run


def symbols(sequences: DataFrame, names: DataFrame, pairs: bool) -> DataFrame:
    own = names.select(F.col("unit").alias("of"), "entry", "id")  # both sides come from one table
    both = sequences.select("unit", "codes").groupBy("unit").cogroup(own.groupBy("of"))
    return both.applyInArrow(renamed(pairs), SEQUENCE)


def numbered(rows: DataFrame) -> DataFrame:
    """A written table's `at` (monotonically increasing: a partition's number over the row's in it) as id from 0 without
    gaps, so that most of its bytes are zeros in shuffles. One row a partition is summed up in one task."""
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.withColumn("part", part).join(starts, "part").withColumn("id", F.col("before") + row).drop("part", "before", "at")


def mine_phrases(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """docs(text, lang) -> lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    a, l, r: occurrences of the phrase and of both parts of its weakest cut; n: words of the language."""
    work = Workspace(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    units = work.save(texts.mapInArrow(lambda batches: cut_units(batches, unit_bytes), UNIT), "units")
    totals = work.save(units.groupBy("lang").agg(F.sum("n").alias("n")), "totals")

    entries = units.select("unit", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("entry", "of")).select("unit", "lang", "entry", F.col("of.words").alias("word"), F.col("of.counts").alias("count"))
    words = entries.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    words = work.save(numbered(work.save(words.withColumn("at", F.monotonically_increasing_id()), "found")), "words")
    forget_shuffles(docs.sparkSession)
    named = entries.select("unit", "lang", "entry", "word").join(small(words.select("lang", "word", "id"), of=words), ["lang", "word"])
    sequences = work.save(symbols(units, named, False), "symbols-1")
    work.drop("units")
    forget_shuffles(docs.sparkSession)
    none = F.array().cast("array<bigint>")
    facts = words.select("id", "lang", F.array("word").alias("words"), "f", none.alias("heads"), none.alias("tails"))
    levels = []
    for k in range(2, longest + 1):
        same, parts = Window.partitionBy("first", "last"), []
        for turn in range(PASSES):
            pairs = sequences.mapInArrow(pairs_of(turn, PASSES), "place long, first long, last long, n long")
            found = pairs.select("place", "first", "last", F.sum("n").over(same).alias("f"), F.min("place").over(same).alias("id"))
            parts.append(work.save(found.where(F.col("f") >= least), f"named-{k}-{turn}"))
            forget_shuffles(docs.sparkSession)
        named = functools.reduce(DataFrame.unionByName, parts)
        names = named.where("place = id").select("id", "first", "last", "f")
        if k < longest:
            own = named.select(F.shiftright("place", ENTRY_BITS).alias("unit"), F.col("place").bitwiseAND((1 << ENTRY_BITS) - 1).alias("entry"), "id")
            sequences = work.save(symbols(sequences, own, True), f"symbols-{k}")
            work.drop(f"symbols-{k - 1}")
            forget_shuffles(docs.sparkSession)
        head = facts.select(F.col("id").alias("first"), "lang", F.col("words").alias("front"), F.col("f").alias("head_f"), "heads")
        tail = facts.select(F.col("id").alias("last"), F.element_at("words", -1).alias("end"), F.col("f").alias("tail_f"), "tails")
        grown = names.join(head, "first").join(tail, "last")
        facts = grown.select("id", "lang", F.concat("front", F.array("end")).alias("words"), "f", F.concat("heads", F.array("head_f")).alias("heads"), F.concat(F.array("tail_f"), "tails").alias("tails"), "first", "last")
        facts = work.save(facts, f"facts-{k}")
        levels.append(facts)
        work.drop(*[f"named-{k}-{turn}" for turn in range(PASSES)])
    candidates = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):
            over = levels[k + 1].select(F.explode(F.array("first", "last")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("over"))
            wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  100 times a long may pass 64 bits
            level = level.join(over, "id", "left").where(F.col("over").isNull() | (wide("over") * 5 < wide("f") * 4))
        level = level.select("lang", "words", "f", "heads", "tails")
        candidates = level if candidates is None else candidates.unionByName(level)
    cuts = F.expr("array_min(transform(arrays_zip(heads, tails), (c, k) -> named_struct('score', cast((cast(2000000 as decimal(7, 0)) * cast(f as decimal(19, 0))) div (cast(c.heads as decimal(19, 0)) + cast(c.tails as decimal(19, 0))) as bigint), 'k', k, 'l', c.heads, 'r', c.tails)))")
    rows = candidates.select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.col("score").desc(), F.col("a").desc(), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return rows.join(small(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


SQL = f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
g AS MATERIALIZED (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS g, count(*) AS a FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, range(1, 5) AS z(s)) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, s, g, a, string_split(g, ' ') AS x, unnest(range(1, s)) AS k FROM g WHERE s > 1),
d AS (SELECT c.lang, c.s, c.g, c.a, k, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (l.a + r.a) AS BIGINT) AS score FROM c JOIN g l ON l.lang = c.lang AND l.g = array_to_string(x[1:k], ' ') JOIN g r ON r.lang = c.lang AND r.g = array_to_string(x[k + 1:], ' ')),
e AS (SELECT lang, s, g, a, unnest([arg_min({{'l': l, 'r': r, 'score': score}}, (score, k))], recursive := true) FROM d GROUP BY lang, s, g, a),
u AS (SELECT lang, array_to_string(x[i:i + m - 1], ' ') AS g, max(a) AS over FROM (SELECT lang, s, a, x, m, unnest(range(1, s - m + 2)) AS i FROM (SELECT lang, s, a, string_split(g, ' ') AS x, unnest(range(2, s)) AS m FROM g WHERE s > 2)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang)
SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, e.g) AS rank, e.g AS phrase, a, l, r, n, score FROM e LEFT JOIN u ON u.lang = e.lang AND u.g = e.g JOIN n ON n.lang = e.lang WHERE u.over IS NULL OR 100 * u.over < 80 * a QUALIFY rank <= 2000"""
