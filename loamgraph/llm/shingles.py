"""N-gram Jaccard join: sets of word shingles that overlap by THRESHOLD of their union.

Order all shingles by (number of documents that hold them, for those found
heavy; hash). Two linked sets of sizes n share a shingle among the first
floor(n / 4) + 1 of each (at 0.75), and two among the first floor(n / 4) + 2.
Size-aware join: sets of at most `boundary` shingles list all 2-subsets of the
latter; larger sets, and those small ones that a larger set may still link
with, list the former for an inverted index. The boundary is where the cost of
subsets passes that of scanning lists, by the sizes and list lengths of the
sets themselves.

Groups under one signature aren't turned into all their pairs. Equal sets are
one class before. In each group the smallest id is the pivot; every member is
compared with it exactly. Only members in different components afterwards can
still add anything, and Jaccard distance is a metric: |d(x, pivot) -
d(y, pivot)| > 1/4 rules a link of x and y out. The pairs that are left are
compared as well, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .common import hashed_words, mixed, own, per_document, release, slices, starting, unused
from .components import components

WORDS, PERCENT = 5, 75
#: Shingles put last in the order: the HEAVY most frequent ones of those that some WINDOW shingles in a row hold SEEN times.
HEAVY, WINDOW, SEEN = 400_000, 2_000_000, 4
#: A signature of shingles all held by more documents than this goes by an aggregate and a join that can be split.
HOT = 20_000
#: Cells of the parity sketch.
BITS = 1024
SMALLEST, COMPARE_COST = 2, 4.0
#: Members outside the pivot's component that one task compares with the rest of a signature.
PART = 1_000

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def raw_shingles(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of each text's shingles as they come; fewer words than WORDS make one shingle, none make none."""
    h, sizes = hashed_words(texts)
    n = max(0, len(h) - WORDS + 1)
    rolled = mixed(sum(h[i : i + n] * _P[i] for i in range(WORDS))) if n else h[:0]
    out, at = [], 0
    for k in sizes.tolist():
        if k >= WORDS:
            out.append(rolled[at : at + k - WORDS + 1])
        elif k:
            out.append(mixed(sum(h[at + i : at + i + 1] * _P[i] for i in range(k)) + np.uint64(k)))
        else:
            out.append(h[:0])
        at += k
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct ones of each text, sorted."""
    return [np.unique(s) if len(s) > 1 else s for s in raw_shingles(texts)]


def shingles(text: str | None) -> np.ndarray:
    return shingle_sets([text])[0]


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most HEAVY frequent shingles. Which ones they are decides the order alone, never the result."""

    def run(batches):
        with starting():  # no task keeps anything large for this one
            held, size = [], 0

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= SEEN
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for s in raw_shingles(part.column("text").to_pylist()):
                    held.append(s)
                    size += len(s)
                    if size >= WINDOW:
                        yield flush()
                        held, size = [], 0
            release()
        if held:
            yield flush()

    got = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    got = got.orderBy(F.desc("n"), "token").limit(HEAVY).toArrow()
    token, n = got.column("token").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def in_order(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """The first `most` of a sorted set in the global order."""
    token, n = heavy
    if not len(token):
        return s[:most]
    at = np.searchsorted(token, s)
    at[at == len(token)] = 0
    known = token[at] == s
    light = s[~known]
    if len(light) >= most:
        return light[:most]
    rest, weight = s[known], n[at[known]]
    return np.concatenate([light, rest[np.lexsort((rest, weight))]])[:most]


def parity(s: np.ndarray) -> list[int]:
    """Whether each of BITS hash cells holds an odd number of the set, packed in longs: two sets differ in as many elements at least as their cells do."""
    odd = (np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def prefix_size(n: int, shared: int) -> int:
    """How many of the first shingles must hold `shared` of those that any linked set shares."""
    return min(n, n - -(-PERCENT * n // 100) + shared)


def linked(inter, n_a, n_b):
    return 100 * inter >= PERCENT * (n_a + n_b - inter)


def _sets(docs: DataFrame, heavy) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), parity sketch and prefix of each row."""
    known = docs.sparkSession.sparkContext.broadcast(heavy)  # at most HEAVY hashes and counts

    def make():
        order = known.value

        def each(rows):
            out = {"doc_id": rows["doc_id"], "n": [], "d1": [], "d2": [], "sketch": [], "prefix": []}
            for s in shingle_sets(rows["text"]):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                out["n"].append(len(s))
                out["d1"].append((d >> 64) - (1 << 63))
                out["d2"].append((d & ((1 << 64) - 1)) - (1 << 63))
                out["sketch"].append(parity(s))
                out["prefix"].append(in_order(s, order, prefix_size(len(s), 2)).tobytes() if len(s) >= SMALLEST else b"")
            return out

        return each

    return per_document(docs, ["doc_id", "text"], "doc_id long, n int, d1 long, d2 long, sketch array<long>, prefix binary", make)


def least_cost(sizes: dict[int, int], others: float) -> int:
    """The largest size whose sets list 2-subsets: where the whole cost is least.

    sizes: how many classes there are of each size. A subset costs 1, an entry
    of a list 1 and COMPARE_COST for each of the `others` that it meets there.
    """
    n = np.array(sorted(sizes), np.int64)
    c = np.array([sizes[k] for k in n.tolist()], np.float64)
    p = np.array([(prefix_size(k, 1), prefix_size(k, 2)) for k in n.tolist()], np.float64).reshape(-1, 2)
    upto = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    subsets, entries = upto(c * p[:, 1] * (p[:, 1] - 1) / 2), upto(c * p[:, 0])
    tried = np.concatenate([[SMALLEST - 1], n[n >= SMALLEST]])
    small = np.searchsorted(n, tried, side="right")
    # small sets that a larger one may link with are in the lists as well
    listed = np.minimum(small, np.searchsorted(n, -(-PERCENT * (tried + 1) // 100)))
    cost = subsets[small] + entries[-1] - entries[listed] + (entries[-1] - entries[small]) * others * COMPARE_COST
    return int(tried[np.argmin(cost)])


def choose_boundary(sets: DataFrame) -> int:
    """least_cost() by the sizes of all sets, each distinct one counted once, and the lengths of the inverted lists of each 64th shingle by hash."""
    some = sets.filter(F.col("n") >= SMALLEST)
    sizes = {r["n"]: r["c"] for r in some.select("n", "d1", "d2").distinct().groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}

    def run(batches):
        for batch in batches:
            tokens, rows = [], []
            for i, (n, p) in enumerate(zip(batch.column("n").to_pylist(), batch.column("prefix").to_pylist(), strict=True)):
                t = np.frombuffer(p, np.uint64)[: prefix_size(n, 1)]
                t = t[t % np.uint64(64) == 0]
                tokens.append(t)
                rows.append(np.full(len(t), i))
            at = np.concatenate(rows) if rows else np.zeros(0, int)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), batch.column("d1").take(pa.array(at))], names=["token", "d1"])

    lists = some.select("n", "d1", "prefix").mapInArrow(run, "token long, d1 long").distinct().groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("c"))
    got = lists.agg(F.sum("c").alias("s"), F.sum(F.col("c") * (F.col("c") - 1)).alias("q")).first()
    return least_cost(sizes, (got["q"] or 0.0) / (got["s"] or 1.0))


def _signatures(reps: DataFrame, boundary: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, rep, hot) of each class; hot: all shingles behind it are held by more than HOT documents."""
    known = reps.sparkSession.sparkContext.broadcast(np.sort(hot[0][hot[1] > HOT]))

    def run(batches):
        often = known.value
        for batch in batches:
            sigs, ids, marks = [], [], []
            for rep, n, p in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                t = np.frombuffer(p, np.uint64)
                is_hot = np.isin(t, often) if len(often) else np.zeros(len(t), bool)
                if n <= boundary:
                    i, j = np.triu_indices(len(t), 1)
                    sigs.append(mixed(np.minimum(t[i], t[j]) * _P[0] + np.maximum(t[i], t[j]) * _P[1]))
                    marks.append(is_hot[i] & is_hot[j])
                    ids.append(np.full(len(i), rep))
                if n > boundary or 100 * n >= PERCENT * (boundary + 1):
                    k = prefix_size(n, 1)
                    sigs.append(t[:k])
                    marks.append(is_hot[:k])
                    ids.append(np.full(k, rep))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(marks))], names=["sig", "rep", "hot"])

    return reps.select("rep", "n", "prefix").mapInArrow(run, "sig long, rep long, hot boolean")


def _stars(signatures: DataFrame) -> DataFrame:
    """(sig, a, b): b shares sig with a, the smallest id that has it."""

    def run(batches):
        sig = pivot = None
        for batch in batches:
            s, r = batch.column("sig").to_numpy(), batch.column("rep").to_numpy()
            if not len(s):
                continue
            first = np.concatenate([[sig is None or s[0] != sig], s[1:] != s[:-1]])
            run_of = np.cumsum(first)
            starts = np.concatenate([[pivot if pivot is not None else 0], r[first]])
            a = starts[run_of]
            sig, pivot = s[-1], a[-1]
            other = ~first & (a != r)
            if other.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[other]), pa.array(a[other]), pa.array(r[other])], names=["sig", "a", "b"])

    spark = signatures.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    usual = signatures.filter("not hot").select("sig", "rep").repartition(n, "sig").sortWithinPartitions("sig", "rep").mapInArrow(run, "sig long, a long, b long")
    hot = signatures.filter("hot").select("sig", "rep").distinct()
    pivots = hot.groupBy("sig").agg(F.min("rep").alias("a"))
    return usual.unionByName(hot.join(pivots, "sig").filter("rep <> a").select("sig", "a", F.col("rep").alias("b")))


def _known_of(stars: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n, s, p) of each id in stars: its set's size, how many of its signatures others have too, its sketch.

    An id whose rows have several texts gets an s beyond any bound.
    """
    use = stars.select(F.col("b").alias("id"), F.lit(1).alias("one")).unionByName(stars.select("sig", "a").distinct().select(F.col("a").alias("id"), F.lit(1).alias("one")))
    use = use.groupBy("id").agg(F.sum("one").alias("s"))
    size = members.filter("n > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n"), (F.min(F.struct("d1", "d2")) != F.max(F.struct("d1", "d2"))).alias("several"), F.first("sketch").alias("p"))
    return materialise(use.join(size, "id").select("id", "n", F.when(F.col("several"), F.lit(1 << 40)).otherwise(F.col("s")).alias("s"), "p"), "sizes")


def _may_link(x: str, y: str, boundary: int):
    """Whether two sets of known n, s and p (columns with these suffixes) may link: sizes and sketches must fit, and their first shingles must have enough in common.

    Of two linked sets take the one whose last listed shingle comes first in
    the order; all that they share up to there is listed by both, so they share
    at least overlap - (n - listed) listed ones, which is at most what either
    shares with anybody. Sets that list 2-subsets aren't judged by this.
    """
    n, s, m, t = (F.col(f"{c}_{side}") for side in (x, y) for c in ("n", "s"))
    several = F.greatest(s, t) >= 1 << 40
    sizes = 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)
    overlap = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    rest = lambda x: x - F.floor(x - F.ceil(PERCENT * x / 100) + 1)
    enough = F.least(s, t) >= overlap - F.greatest(rest(n), rest(m))
    differ = F.aggregate(F.zip_with(f"p_{x}", f"p_{y}", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return several | (sizes & ((F.least(n, m) <= boundary) | enough) & (differ <= n + m - 2 * overlap))


def _compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, d): exact Jaccard distance of each pair, and whether it links; the texts of ids in pairs are read again."""
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")

    def run(batches):
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            d, hit = [], []
            sets = iter(shingle_sets(batch.column("y").to_pylist()))
            for a, x in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), strict=True):
                if last != (a, x):  # rows come by pivot, whose set is made once
                    last, kept = (a, x), shingles(x)
                q = next(sets)
                inter = len(np.intersect1d(kept, q, assume_unique=True))
                union = len(kept) + len(q) - inter
                d.append(1 - inter / union if union else 1.0)
                hit.append(bool(union) and bool(linked(inter, len(kept), len(q))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d, pa.float64()), pa.array(hit, pa.bool_())], names=["a", "b", "d", "link"])
            release()

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, d double, link boolean")
    # an id that repeats with other texts counts with its nearest one
    return materialise(both.groupBy("a", "b").agg(F.min("d").alias("d"), F.max("link").alias("link")), "compared")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable by links, the row's own included).

    Words are runs of other characters than white space, A-Z made lower case;
    a set holds the distinct WORDS-word shingles of the whole text, or one
    shingle of all words where they are fewer. A null or empty text, or one
    without words, has no shingles and is linked with nothing. Equal texts link
    (their sets are equal). Rows of one id are one document: if their texts
    differ, each brings its links. A row without an id keeps a null component.
    An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = heavy_shingles(docs)
    sets = materialise(_sets(docs, heavy), "sets")
    members = materialise(sets.select("doc_id", "n", "d1", "d2", "sketch"), "members")
    some = sets.filter("n > 0 and doc_id is not null")
    boundary = choose_boundary(some)
    reps = some.filter(F.col("n") >= SMALLEST).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # one prefix a set is left: what all rows have goes before signatures are dealt out
    reps = materialise(reps, "reps")
    discard(sets)
    stars = materialise(_stars(_signatures(reps, boundary, heavy)), "stars")
    discard(reps)
    known = _known_of(stars, members)
    of = lambda side: known.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}"), F.col("p").alias(f"p_{side}"))
    tried = stars.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    tried = tried.filter(_may_link("a", "b", boundary)).select("a", "b")
    compared = _compared(docs, materialise(tried, "pairs"))
    links = compared.filter("link").select("a", "b")
    # rows of one id with different texts join their classes
    # grouped by another form of the key: the join below then deals both sides out anew, and a set with very many members can be split
    classes = members.filter("n > 0 and doc_id is not null").groupBy(F.bitwise_not("d1").alias("e1"), "d2").agg(F.min("doc_id").alias("rep")).select(F.bitwise_not("e1").alias("d1"), "d2", "rep")
    many = members.filter("n > 0 and doc_id is not null").select("doc_id", "d1", "d2").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    bridges = members.join(many, "doc_id", "left_semi").join(classes, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    first = materialise(components(links.unionByName(bridges)), "components")
    left = _left_over(stars, compared, first, known, boundary)
    if not left.isEmpty():
        again = _compared(docs, left)
        edges = first.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(again.filter("link").select("a", "b"))
        first = materialise(components(edges), "components")
    out = members.join(classes, ["d1", "d2"], "left").join(first.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def _left_over(stars: DataFrame, compared: DataFrame, comp: DataFrame, known: DataFrame, boundary: int) -> DataFrame:
    """Pairs of one signature that lie in different components, aren't compared yet and may still link.

    A member's distance from its signature's pivot is known where the two were
    compared; else it lies between 1/4 and 1.
    """
    of = lambda name, side: comp.select(F.col("id").alias(side), F.col("component").alias(name))
    pairs = stars.select("a", "b").distinct().join(compared, ["a", "b"], "left").join(of("ca", "a"), "a", "left").join(of("cb", "b"), "b", "left")
    pairs = pairs.select("a", "b", F.coalesce("d", F.lit(1 - PERCENT / 100)).alias("lo"), F.coalesce("d", F.lit(1.0)).alias("hi"), F.coalesce("cb", "b").alias("c"), (F.coalesce("ca", "a") != F.coalesce("cb", "b")).alias("open"))
    members = stars.join(pairs, ["a", "b"]).select("sig", "b", "lo", "hi", "c", "open")
    # signatures with a member outside the pivot's component, and another member; the former are cut into `parts` that meet the rest one by one
    groups = members.groupBy(F.bitwise_not("sig").alias("key")).agg(F.count(F.lit(1)).alias("k"), F.max("open").alias("any"), F.count_if("open").alias("outside")).filter("any and k > 1")
    groups = groups.select(F.bitwise_not("key").alias("sig"), F.ceil(F.col("outside") / PART).cast("int").alias("parts"))
    # sizes and sketches only go with what is left
    members = materialise(members.join(groups, "sig").join(known.withColumnRenamed("id", "b"), "b").select("sig", "parts", "b", "lo", "hi", "c", "open", "n", "s", "p"), "left-members")
    several = F.col("s") >= 1 << 40  # an id with several texts is of no one size
    mixed_up = not members.filter(several).isEmpty()
    if mixed_up:
        odd = members.filter(several & F.col("open")).select("sig").distinct().withColumn("odd", F.lit(True))
        members = members.join(odd, "sig", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    # linked sets' sizes differ by a third at most, so they are in the same band of sizes or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / PERCENT)) + 1e-9).cast("int")
    some, all_of = F.lit(-2), F.lit(-1)
    x = members.filter("open").withColumn("band", F.explode(F.when(several, F.array(all_of)).otherwise(F.array(band - 1, band, band + 1, *([some] if mixed_up else [])))))
    x = x.select("sig", "band", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_x") for c in ("b", "lo", "hi", "c", "n", "s", "p")])
    y = members.withColumn("band", F.explode(F.array_compact(F.array(F.when(several, some).otherwise(band), F.when(F.col("odd"), all_of)))) if mixed_up else band)
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.select("sig", "band", "part", *[F.col(c).alias(f"{c}_y") for c in ("b", "lo", "hi", "c", "open", "n", "s", "p")])
    near = 1 - PERCENT / 100 + 1e-9
    may = (F.col("c_x") != F.col("c_y")) & (F.col("lo_x") - F.col("hi_y") <= near) & (F.col("lo_y") - F.col("hi_x") <= near) & (~F.col("open_y") | (F.col("b_x") < F.col("b_y")))
    may = may & _may_link("x", "y", boundary)
    pairs = x.join(y, ["sig", "part", "band"]).filter(may).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct()
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialise(pairs.join(done, ["a", "b"], "left_anti"), "left-pairs")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns unchanged, with one row of each component: a row of the component's smallest id.

    Rows without shingles or id all stay. Of rows that repeat an id one stays,
    whatever their texts are. An empty table stays empty. Columns may have any
    names.
    """
    has, rows_of, at = unused(docs, "_words", "_rows", "_id")
    found = jaccard_components(docs)
    keep = found.filter((F.col("doc_id") == F.col("component_id")) & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows_of))
    keep = materialise(keep, "keep").withColumnRenamed("doc_id", at)
    words = F.coalesce(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    rows = docs.withColumn(has, words & F.col("doc_id").isNotNull())
    # the ids grow with the documents, so they are never broadcast
    some = rows.filter(has).join(keep.hint("merge"), F.col("doc_id").cast("long") == F.col(at))
    single = some.filter(F.col(rows_of) == 1).select(*own(docs))
    several = some.filter(F.col(rows_of) > 1).select(*own(docs)).dropDuplicates(["doc_id"])
    return single.unionByName(several).unionByName(rows.filter(~F.col(has)).select(*own(docs)))


def op4_shingle_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.75 on five-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE a.g IN (SELECT g FROM often) GROUP BY 1, 2
), pairs AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id
"""
