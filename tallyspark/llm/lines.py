"""Line dedup by an exact set-similarity join.

A line is its set of words (lower case, cut at white space). A line goes if an earlier one, by (id, line
number), has Jaccard similarity of at least the threshold with it; lines without words stay.

Lines of equal sets form a class, and its first line stands for it. Words are ordered by rarity, taken from a
count sketch of fixed size, ties by hash. An earlier and a later class are compared if the prefixes of their
ordered words share one, and length, position and a parity bitmap of the words leave the threshold in reach;
what stays is verified on the words.

A template with thousands of variants would make pairs of all of them. So a first pass compares each class
with the first line of its groups under neighbours of fixed points among its word hashes; those it removes
("settled") need no further partner: of the join only pairs count whose later class is not settled. Classes are
numbered in the order of their first lines, so the join sees which one is later.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, let, small, table

THRESHOLD = 0.8
#: Buckets of the count sketch, which comes to the driver and goes into plans: so many bytes, whatever the input.
SKETCH_LOG2 = 17
#: Hashes of the words of a line that holds no separator but blanks, each once; cutting at one character is much faster than at a pattern.
WORDS = "array_remove(array_distinct(transform(split(lower(line), ' '), w -> xxhash64(w))), xxhash64(''))"
#: Separators of words other than blanks (a line break ends a line).
OTHERS = "\t\x0b\x0c\r"
CLASS = ["k", "even", "odd", "n"]
#: Parity bitmaps of the words with even and with odd hashes.
BITS = ["even", "odd"]
PLACE = ["id", "th", "line_no"]
#: Points of the circle of word hashes. The words of a line next to a point, before and after it, are a group key:
#: a variant keeps one of four such pairs far more often than one of two.
POINTS = [-(2**63), -(2**62), 0, 2**62]


def blanks(text: Column) -> Column:
    """The text with blanks for the other separators of words. Few texts hold any, and a search for each is cheap."""
    some = F.lit(False)
    for c in OTHERS:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.translate(text, OTHERS, " " * len(OTHERS))).otherwise(text)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (hash of the text), line_no (from 0), line of every line with words; null text: none."""
    text = F.col(f"`{text_col}`")
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(blanks(text), "\n")).alias("line_no", "line"))
    return lines.where(F.trim("line") != "")  # a test on the words would cut every line twice


def rarity_sketch(docs: DataFrame, text_col: str) -> list[int]:
    """For each bucket of word hashes a number up to 126 that grows with the logarithm of its number of words."""
    words = docs.select(F.replace(blanks(F.col(f"`{text_col}`")), F.lit("\n"), F.lit(" ")).alias("line")).select(F.explode(F.expr("split(lower(line), ' ')")).alias("w"))
    rows = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << SKETCH_LOG2) - 1)).alias("b")).agg(F.count("*").alias("c")).select("b", F.floor(F.log2("c") * 3).cast("int").alias("code")).collect()
    out = [0] * (1 << SKETCH_LOG2)
    for b, code in rows:
        out[b] = min(code, 126)
    return out


def encode_lines(lines: DataFrame, sketch: list[int], threshold: float) -> DataFrame:
    """Lines with words: id, th, line_no, class key (k, even, odd, n), prefix (ints, rarest first) and groups (a key for each of POINTS)."""
    mask = (1 << SKETCH_LOG2) - 1
    hashed = lines.select(*PLACE, F.expr(WORDS).alias("h"))
    # the sketch is a literal inside the expression, folded once; as a column it would be copied into every row
    codes = F.from_json(F.lit(json.dumps(sketch, separators=(",", ":"))), "array<tinyint>")
    # no code is null, which coalesce tells the sort: it then sorts plain longs
    ranked = F.sort_array(F.transform("h", lambda x: F.shiftleft(F.coalesce(F.get(codes, x.bitwiseAND(F.lit(mask)).cast("int")), F.lit(0)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8))))
    tokens = hashed.select(*PLACE, "h", ranked.alias("t"), F.size("h").alias("n"), F.sort_array(F.concat("h", F.array(*map(F.lit, POINTS[1:])))).alias("circle"))
    tokens = tokens.withColumn("all", F.expr("aggregate(h, 0L, (a, x) -> a ^ shiftleft(1L, cast(shiftrightunsigned(x, 58) as int)))"))
    tokens = tokens.withColumn("even", F.expr("aggregate(h, 0L, (a, x) -> if((x & 1L) = 0L, a ^ shiftleft(1L, cast(shiftrightunsigned(x, 58) as int)), a))"))
    at = [F.array_position("circle", F.lit(p)).cast("int") for p in POINTS[1:]]
    around = [(F.get("circle", F.size("circle") - 1), F.get("circle", F.lit(0))), *((F.get("circle", i - 2), F.get("circle", i)) for i in at)]
    return tokens.select(
        *PLACE,
        F.xxhash64("t").alias("k"),
        "even",
        F.col("all").bitwiseXOR(F.col("even")).alias("odd"),
        "n",
        F.expr(f"transform(slice(t, 1, n - cast(ceil({threshold}D * n - 1e-9D) as int) + 1), x -> cast(x & 2147483647 as int))").alias("prefix"),
        F.array(*(F.xxhash64(*pair, F.lit(i)) for i, pair in enumerate(around))).alias("groups"),
    )


def fits(a: str, b: str, threshold: float, sizes: list[Column] | None = None) -> Column:
    """Whether parity bitmaps and sizes (columns n if not given) of sides a and b leave the threshold in reach."""
    n, m = sizes or (F.col(f"{a}.n"), F.col(f"{b}.n"))
    most = (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9  # words in one of the sets only, at most
    apart = [F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITS]
    return (apart[0] <= most) & (apart[0] + apart[1] <= most) & (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9)


def place() -> Column:
    return F.struct(*PLACE)


def first_places(lines: DataFrame, work: Workspace) -> DataFrame:
    """CLASS and first (place) of the classes that have several lines; only those lines are sorted by place."""
    several = work.save(lines.groupBy(*CLASS).agg(F.count("*").alias("c")).where("c > 1").drop("c"), "several")
    again = lines.select(*PLACE, *CLASS).join(small(several), CLASS)
    return work.save(again.groupBy(*CLASS).agg(F.min(place()).alias("first")), "repeated")


def representatives(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of lines for every class, that of its first place."""
    joined = lines.join(repeated, CLASS, "left")
    once = joined.where("first is null").drop("first")
    first = joined.where(F.col("first") == place()).drop("first").dropDuplicates(CLASS)  # rows that repeat id and text
    return once.unionByName(first.select(*once.columns))


def words_at(places: DataFrame, docs: DataFrame, work: Workspace, name: str, id_col: str, text_col: str) -> DataFrame:
    """r and words (hashes) for each of places (r, id, th, line_no)."""
    places = work.save(places, f"{name}-places")
    wanted = work.save(places.groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_list(F.struct("line_no", "r")).alias("wanted")), f"{name}-wanted")
    same = F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # a text is cut into lines once, however many of them are wanted
    found = let(F.split(blanks(F.col("text")), "\n"), lambda cut: F.transform("wanted", lambda x: F.struct(x["r"].alias("r"), F.get(cut, x["line_no"]).alias("line"))))
    words = texts.join(small(wanted), same).select(F.inline(found)).select("r", F.expr(WORDS).alias("words"))
    words = work.save(words, f"{name}-words")
    return words if words.count() == places.count() else words.dropDuplicates(["r"])  # rows that repeat id and text


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of classes, a the earlier, those that reach the threshold by their words: r of the later one, once."""
    left, right = words.select(F.col("r").alias("a"), F.col("words").alias("x")), words.select(F.col("r").alias("b"), F.col("words").alias("y"))
    met = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("x", "y")) >= threshold / (1 + threshold) * (F.size("x") + F.size("y")) - 1e-9)
    return met.select(F.col("b").alias("r")).distinct()


def settled_first(reps: DataFrame, docs: DataFrame, work: Workspace, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """r of the classes that match the first line of a group of theirs."""
    pivots = reps.select("r", F.explode("groups").alias("key")).groupBy("key").agg(F.min("r").alias("p"), F.count("*").alias("c")).where("c > 1")
    pivots = work.save(pivots.drop("c"), "pivots")
    members = reps.select("r", *BITS, "n", F.explode("groups").alias("key")).join(small(pivots), "key").where("r <> p")
    members = work.save(members.drop("key").distinct(), "members")
    near = small(members).alias("m").join(reps.select(F.col("r").alias("first"), *BITS, "n").alias("p"), F.col("m.p") == F.col("p.first")).where(fits("m", "p", threshold))
    near = work.save(near.select(F.col("m.p").alias("a"), F.col("m.r").alias("b")), "near")
    places = reps.select("r", *PLACE).join(small(work.save(near.select(F.explode(F.array("a", "b")).alias("r")).distinct(), "near-ids")), "r", "left_semi")
    settled = work.save(verified(near, words_at(places, docs, work, "near", id_col, text_col), threshold), "settled")
    work.drop("pivots", "members", "near", "near-ids", "near-places", "near-wanted", "near-words")
    return settled


def joined_prefixes(reps: DataFrame, settled: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes whose prefixes share a word and that may reach the threshold, a the earlier, b not settled.

    Two sets that reach it share 2 t / (1 + t) of the smaller one's words at least, so of the smaller set a prefix
    of half the length does ("short"). Of equal sizes both short prefixes share a word, so either may be the smaller."""
    marked = reps.select("r", *BITS, "n", "prefix").join(small(settled.withColumn("settled", F.lit(1))), "r", "left")
    # one narrow row for each word of a prefix: n, place in the order, short and state share a long, taken apart in
    # the join only, so that both sides are one exchange
    short = F.col("pos") < F.col("n") - F.ceil(2 * threshold / (1 + threshold) * F.col("n") - 1e-9) + 1
    parts = [F.shiftleft(F.col("n").cast("long"), 32), F.shiftleft(F.col("pos").cast("long"), 2), F.when(short, 2).otherwise(0), F.coalesce("settled", F.lit(0))]
    packed = marked.select("r", *BITS, "n", "settled", F.posexplode("prefix").alias("pos", "word")).select("word", "r", *BITS, sum(parts).cast("long").alias("meta"))
    s, l = packed.alias("s"), packed.alias("l")  # noqa: E741
    meta, r, n, rest = ([f(x) for x in "sl"] for f in (lambda x: F.col(f"{x}.meta"), lambda x: F.col(f"{x}.r"), lambda x: F.shiftright(f"{x}.meta", 32), lambda x: F.shiftright(f"{x}.meta", 32) - F.shiftright(F.col(f"{x}.meta").bitwiseAND(F.lit(0xFFFFFFFF)), 2)))
    once = (meta[0] < meta[1]) | ((meta[0] == meta[1]) & (r[0] < r[1]))
    # short, and the later one not settled, as one term of both sides: a term of one side would part the exchanges
    later = F.when(r[0] < r[1], meta[1]).otherwise(meta[0])
    asked = meta[0].bitwiseAND(F.lit(2)).bitwiseXOR(F.lit(2)) + later.bitwiseAND(F.lit(1)) < 1
    reach = F.least(*rest) >= threshold / (1 + threshold) * (n[0] + n[1]) - 1e-9
    met = s.join(l, (F.col("s.word") == F.col("l.word")) & once & asked & fits("s", "l", threshold, n) & reach)
    return met.select(F.least(*r).alias("a"), F.greatest(*r).alias("b")).distinct()


def removed_classes(docs: DataFrame, reps: DataFrame, work: Workspace, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """CLASS of all classes that match an earlier one."""
    settled = settled_first(reps, docs, work, threshold, id_col, text_col)
    pairs = work.save(joined_prefixes(reps, settled, threshold), "pairs")
    places = reps.select("r", *PLACE).join(small(work.save(pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct(), "pair-ids")), "r", "left_semi")
    words = words_at(places, docs, work, "pair", id_col, text_col)
    later = work.save(settled.unionByName(verified(pairs, words, threshold)).distinct(), "later")
    removed = work.save(reps.join(small(later), "r", "left_semi").select(*CLASS), "removed")
    work.drop("pairs", "pair-ids", "pair-places", "pair-wanted", "pair-words", "later", "settled")
    return removed


def repeated_lines(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each (id, th) that has lines to remove: id, th (xxhash64 of the text), removed (ascending line
    numbers from 0). Rows that repeat id and text are one document; null ids come first. Lines of any length are
    compared whole. Other columns of docs are not read. An empty table gives an empty result."""
    work = Workspace(docs.sparkSession)
    lines = work.save(encode_lines(lines_of(docs, id_col, text_col), rarity_sketch(docs, text_col), threshold), "lines")
    repeated = small(first_places(lines, work))
    # classes get numbers in the order of their places, fixed once they are written
    found = work.save(representatives(lines, repeated), "found")  # sorting reads its input twice
    reps = work.save(found.sort(*PLACE).withColumn("r", F.monotonically_increasing_id()), "reps")
    work.drop("found")
    removed = small(removed_classes(docs, reps, work, threshold, id_col, text_col))
    work.drop("reps", "several")
    # all lines of a removed class go, of the others all but the first
    marked = lines.select(*PLACE, *CLASS).join(repeated, CLASS, "left").join(removed.withColumn("gone", F.lit(True)), CLASS, "left")
    gone = marked.where(F.col("gone") | (F.col("first") != place()))
    return gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its repeated lines. All rows and columns stay; null texts stay null."""
    gone = repeated_lines(docs, threshold=threshold, id_col=id_col, text_col=text_col).withColumnsRenamed({"id": "__id", "th": "__th", "removed": "__gone"})
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__th"))
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\n'), (x, i) -> not array_contains(__gone, i)), '\n')")
    text = F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(kept)
    return docs.join(gone, same, "left").withColumn(text_col, text).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = repeated_lines(docs).withColumnsRenamed({"id": "gid", "th": "gth"})
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = base.join(gone, base["doc_id"].eqNullSafe(gone["gid"]) & (base["th"] == gone["gth"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


SQL = r"""
WITH l AS (SELECT doc_id, s - 1 AS line_no, lines[s] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM l),
c AS (SELECT words, len(words) AS n, min((doc_id, line_no)) AS first FROM w WHERE len(words) > 0 GROUP BY words),
p AS (SELECT first, n, words, unnest(words[1:n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1]) AS word FROM c),
m AS (SELECT DISTINCT a.first AS f, b.first AS g, a.n AS n, b.n AS m, a.words AS x, b.words AS y FROM p a JOIN p b ON a.word = b.word AND a.first < b.first AND a.n BETWEEN 0.8 * b.n - 1e-9 AND b.n / 0.8 + 1e-9),
gone AS (SELECT DISTINCT g AS first FROM m WHERE 9 * len(list_intersect(x, y)) >= 4 * (n + m)),
r AS (SELECT doc_id, line_no FROM w JOIN c USING (words) WHERE (doc_id, line_no) <> c.first OR c.first IN (SELECT first FROM gone)),
d AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS names FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(d.n, 0)::BIGINT AS n_removed, coalesce(d.names, '') AS removed_lines FROM documents LEFT JOIN d USING (doc_id)
"""
