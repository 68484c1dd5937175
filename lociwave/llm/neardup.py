"""MinHash near-dedup: one-permutation hashing, banded buckets, star edges.

A text's set is its distinct 5-word shingles as 64-bit hashes. Texts with equal
sets are one class. A class hashes its set once; each of ``BINS`` bins keeps its
smallest hash, and an empty bin takes the value of the first filled bin on its
own random probe sequence (optimal densification). ``BANDS`` bands of ``ROWS``
bins give bucket keys: at similarity 0.75 two large classes share none of the
buckets with probability 3e-7. Small sets fill few bins, so their buckets depend on
one another and miss more often (5 in 100,000 draws for sets of 3 and 4; none in 400,000
from 70 shingles on); sets of at most ``SMALL`` shingles (and those that
may be similar to one) therefore also have a bucket for each of their first
``n - ceil(0.75 n) + 1`` hashes, one of which two similar sets are bound to share.

Candidates are stars, not pairs: in each round every bucket has one centre and
each class keeps the centre it meets in most buckets, so a round confirms one
edge per class at most, on full sets. The centre is the class with the most bucket mates (the
original of its copies), in every second round the least by a hash. Links merge labels; buckets whose classes have one label are done. When a
round no longer halves what is open (two classes of one bucket with different
labels), the classes of open buckets meet once more through an exact filter:
with their shingles ordered by frequency, rarest first, two sets that are similar
enough share one of the first ``n - ceil(0.75 n) + 1``, at places that leave room
for the overlap they need. A passage that thousands of texts share is frequent
and so stands at the end: it fills buckets, but makes no pairs. So no link that
shares a bucket is lost, and a large group costs stars, not pairs.

Edges to a centre with many members are salted by degree. Tables between steps
lie in the shared folder, and are dropped once nothing reads them. A null or empty
text has an empty set and links with nothing; a very long text is one set, made in
one task; a null id never is a group's smallest; repeated rows (same id, same text)
are one class and get the same result; an empty table gives no rows; other columns,
whatever their names, stay in ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, list_array, maybe_broadcast, mix64, slices, table, written
from .components import components
from .textkernel import chained, hashes, raw, spans

SHINGLE = 5
SIMILAR = 75
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Sets up to this size get buckets that no similar set can miss.
SMALL = 48
MOST_STARS = 6
#: A further round of stars must leave at most this share of the open pairs open.
WORTH = 0.5
STAR_EDGES = 1024
#: Rows of a token that one task of the prefix filter joins.
TOKEN_ROWS = 1024
#: Bucket keys that a broadcast may hold (8 bytes each).
BROADCAST_KEYS = 500_000


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one as a whole."""
    data, offsets = raw(column)
    starts, ends, first = spans(data, offsets)
    h = hashes(data, starts, ends)
    runs = chained(h, shingle)
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        else:
            out.append(mix64(chained(h[a:b], int(b - a)) + np.uint64(b - a)) if b > a else h[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """A 128-bit key of each set, whatever its order; None for an empty one."""
    out = []
    for u in sets:
        parts = [mix64(np.array([mix64(u ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        out.append(np.concatenate(parts).tobytes() if len(u) else None)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches (rows of BINS values) of sets that are not empty."""
    size = [len(u) for u in sets]
    doc, u = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    bins = ((u >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    # Hashes are sorted, so the first of a bin is its smallest.
    cell = doc * BINS + bins
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    out = np.zeros(len(sets) * BINS, np.uint64)
    filled = np.zeros(len(sets) * BINS, bool)
    out[cell[head]], filled[cell[head]] = u[head], True
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        attempt += 1
        at = mix64((empty % BINS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)
        source = empty - empty % BINS + at.astype(np.int64)
        found = filled[source]
        out[empty[found]] = out[source[found]]
        empty = empty[~found]
    return out.reshape(len(sets), BINS)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sketch[:, r::ROWS])
    return key.view(np.int64)


def sure_keys(u: np.ndarray, similar: int) -> np.ndarray:
    """Bucket keys of a small set's first hashes: of two similar sets in one order, the prefixes meet."""
    if len(u) * similar > SMALL * 100:
        return np.zeros(0, np.int64)
    return mix64(u[: len(u) - -(-len(u) * similar // 100) + 1] ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)


def profile(df: DataFrame, id_col: str, text_col: str, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, rid, n, key, bands): rid also tells rows with a null id apart by text."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("rid", F.coalesce("doc_id", F.xxhash64("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                sets = sets_of(batch.column("text"))
                keys = set_keys(sets)
                bands = [np.zeros(0, np.int64)] * len(sets)
                if full := [i for i, u in enumerate(sets) if len(u)]:
                    for i, own in zip(full, bands_of(sketches([sets[i] for i in full])), strict=True):
                        bands[i] = np.unique(np.concatenate([own, sure_keys(sets[i], similar)]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array([len(u) for u in sets], pa.int64()), pa.array(keys, pa.binary()), list_array(bands, pa.int64())], ["doc_id", "rid", "n", "key", "bands"])

    return rows.mapInArrow(run, "doc_id long, rid long, n long, key binary, bands array<long>")


def class_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(c, h): the full sets of the wanted classes (rid, key, c), one row each."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))).alias("rid"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(maybe_broadcast(wanted), "rid").select("c", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                sets = sets_of(batch.column("text"))
                same = [i for i, (a, b) in enumerate(zip(set_keys(sets), batch.column("key").to_pylist(), strict=True)) if a == b]
                yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(same, pa.int64())), list_array([sets[i].view(np.int64) for i in same], pa.int64())], ["c", "h"])

    return rows.mapInArrow(run, "c long, h array<long>").dropDuplicates(["c"])


def confirmed(edges: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough; a may be a hot centre."""
    degree = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_EDGES).cast("int").alias("salts"))
    degree = maybe_broadcast(written(degree, "nd-degree"))
    left = sets.join(degree, sets.c == degree.a).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("h").alias("ha"))
    right = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    right = right.join(sets, F.col("b") == sets.c).select("a", "b", "salt", F.col("h").alias("hb"))
    both = left.join(right, ["a", "salt"]).select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("i"))
    return both.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * similar).select("a", "b")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (c, n, label) after the links (a, b) between classes."""
    own = labels.select("c", "label")
    ends = links.join(own.withColumnsRenamed({"c": "ca", "label": "la"}), F.col("a") == F.col("ca")).join(own.withColumnsRenamed({"c": "cb", "label": "lb"}), F.col("b") == F.col("cb"))
    roots = maybe_broadcast(components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))))
    return written(labels.join(roots, F.col("label") == F.col("v"), "left").select("c", "n", F.coalesce("root", "label").alias("label")), "nd-labels")


def _open(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """The buckets (b, c) with more than one label, with labels; and how many pairs across labels they hold."""
    rows = buckets.select("b", "c").join(maybe_broadcast(labels), "c")
    per = rows.groupBy("b", "label").agg(F.count(F.lit(1)).alias("m"))
    per = per.groupBy("b").agg(F.sum("m").alias("members"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).cast("long").alias("pairs")).where("pairs > 0")
    per = written(per, "nd-open")
    left = per.agg(F.sum("pairs")).first()[0] or 0
    return written(rows.join(maybe_broadcast(per.select("b", "members"), BROADCAST_KEYS), "b"), "nd-buckets"), left


def _remaining(buckets: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): pairs of classes of open buckets, with different labels, that pass the prefix, length and positional filters."""
    open_classes = written(buckets.select("c", "n", "label").distinct(), "nd-left")
    tokens = sets.join(maybe_broadcast(open_classes), "c").select("c", "n", "label", F.explode("h").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = tokens.join(often, "t", "left").groupBy("c", "n", "label").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "t"))).alias("o"))
    size = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1
    prefix = order.select("c", "n", "label", F.posexplode(F.slice("o", F.lit(1), size.cast("int"))).alias("pos", "x")).where("x.f > 1")
    prefix = prefix.select(F.col("x.t").alias("t"), "c", "n", "label", "pos", F.ceil(F.col("x.f") / TOKEN_ROWS).cast("int").alias("salts"))
    prefix = written(prefix.withColumn("salt", F.pmod(F.xxhash64("c"), F.col("salts")).cast("int")), "nd-prefix")
    # The rows of a frequent token are spread over salts; the other side goes to each of them.
    named = lambda i: [F.col(x).alias(f"{x}{i}") for x in ("c", "n", "label", "pos")]
    one = prefix.select("t", "salt", *named(1))
    two = prefix.select("t", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *named(2))
    need = F.ceil((F.col("n1") + F.col("n2")) * similar / (100 + similar))
    fits = (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * similar) & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need)
    pairs = one.join(two, ["t", "salt"]).where((F.col("c1") < F.col("c2")) & (F.col("label1") != F.col("label2")) & fits)
    return pairs.select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct()


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, key, component_id) for each row; key is the set's, null if empty."""
    rows = written(profile(df, id_col, text_col, similar), "nd-rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "nd-classes")
    buckets = classes.select("c", F.explode("bands").alias("b"))
    shared = written(buckets.groupBy("b").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("b"), "nd-shared")
    buckets = written(buckets.join(maybe_broadcast(shared, BROADCAST_KEYS), "b").select("b", "c"), "nd-buckets")
    delete(shared)
    labels = classes.join(maybe_broadcast(written(buckets.select("c").distinct(), "nd-members")), "c", "left_semi").select("c", "n", F.col("c").alias("label"))
    labels = written(labels, "nd-labels")
    total = labels.count()
    if total:
        wanted = classes.join(maybe_broadcast(labels.select("c")), "c", "left_semi").select("rid", "key", "c")
        sets = written(class_sets(df, id_col, text_col, written(wanted, "nd-wanted")), "nd-sets")
    before = None
    for turn in range(MOST_STARS + 1):
        if not total:
            break
        done = buckets
        buckets, left = _open(buckets, labels)
        delete(done)
        if not left:
            break
        last = turn == MOST_STARS or (before is not None and left > WORTH * before)
        before = left
        if last:
            edges = _remaining(buckets, sets, similar)
        else:
            known = buckets.groupBy("c").agg(F.sum("members").alias("mates"))
            order = F.struct((-F.col("mates") if turn % 2 == 0 else F.lit(0)).alias("mates"), F.xxhash64("c", F.lit(turn)).alias("o"), "c", "label", "n")
            centre = buckets.join(maybe_broadcast(written(known, "nd-mates")), "c").groupBy("b").agg(F.min(order).alias("s")).select("b", F.col("s.c").alias("a"), F.col("s.label").alias("la"), F.col("s.n").alias("na"))
            met = buckets.join(maybe_broadcast(written(centre, "nd-centres"), BROADCAST_KEYS), "b").where("c <> a and label <> la").where(F.least("n", "na") * 100 >= F.greatest("n", "na") * similar)
            met = met.groupBy("c", "a").agg(F.count(F.lit(1)).alias("votes")).groupBy("c").agg(F.max(F.struct("votes", "a")).alias("s"))
            edges = met.select(F.col("s.a").alias("a"), F.col("c").alias("b"))
        edges = written(edges, "nd-edges")
        links = written(confirmed(edges, sets, similar), "nd-links")
        done, labels = labels, _relabel(labels, links)
        delete(edges, links, done)
        if last:
            break
    if total:
        delete(sets)
    named = classes.select("c", "key", "id").join(labels.select("c", "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = written(named.join(least, "label").select(F.col("key").alias("k"), "component_id"), "nd-named")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(maybe_broadcast(named), F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "n_shingles", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keeps(doc_id: Column, component_id: Column) -> Column:
    return doc_id.eqNullSafe(component_id)


def with_key(df: DataFrame, text_col: str, key_col: str) -> DataFrame:
    @F.arrow_udf("binary")
    def keyed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            pieces = slices(pa.RecordBatch.from_arrays([column], ["text"]), "text")
            yield pa.array([k for piece in pieces for k in set_keys(sets_of(piece.column(0)))], pa.binary())

    return df.withColumn(key_col, keyed(F.col(text_col).cast("string")))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without all but one document of each group; rows with no shingle all stay.

    With unique ids the ids that go are enough. Otherwise rows are told apart by
    id and set, and of rows that repeat both one stays.
    """
    found = written(cluster(df, id_col, text_col), "nd-found")
    gone = found.where(~keeps(F.col("doc_id"), F.col("component_id")) & F.col("key").isNotNull())
    unique = found.agg((F.count(F.lit(1)) == F.count_distinct("doc_id")).alias("u")).first()["u"]
    if unique:
        gone = maybe_broadcast(gone.select(F.col("doc_id").alias("__gone")))
        return df.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    rows = with_key(df, text_col, "__key")
    gone = maybe_broadcast(gone.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct())
    rows = rows.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__gone")) & (F.col("__key") == F.col("__gone_key")), "left_anti")
    return rows.where("__key is null").unionByName(rows.where("__key is not null").dropDuplicates([id_col, "__key"])).drop("__key")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents."""
    found = cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", keeps(F.col("doc_id"), F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, UNNEST(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""
