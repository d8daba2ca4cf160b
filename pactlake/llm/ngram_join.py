"""N-gram Jaccard join: connected documents by an exact grouped prefix join on word shingles.

A document's set holds its distinct shingles of `width` words (A-Z folded); a text with fewer words has one
shingle, its whole sequence. Two documents link when 100 * |intersection| >= `percent` * |union|.

Documents with equal sets form one class. One order holds for all shingles: those with a 64-bit hash below a
bound come first, rarest first by the exact number of classes that hold them (ties by hash), all others follow
by hash. So only the shingles below the bound need counts (`sampled_share` of all, a little more than a
prefix), and an ordinary text's prefix consists of shingles that it alone holds. Linked sets share a shingle in
their prefixes, the first n - ceil(percent * n / 100) + 1 shingles. Only prefix shingles that several classes
hold are kept, with their positions. Classes with the same size and the same prefix, all of it held by others,
are collapsed into one group. Group pairs that share a prefix shingle must pass three exact filters: length,
position (nothing before the first shared shingle can match), and a bitmap: each class carries the parities of
its shingles in 512 cells, whose differences never exceed the symmetric difference; a group carries what its
members' bitmaps have in common. Pairs that are left are expanded to members, filtered again by the members'
own bitmaps and verified on the whole sets.

Only connections are asked for, so links are not all listed. First every shingle elects a pivot group (the one
with the fewest rarer shingles before it), whose first member is compared with the members of all other groups,
and every group's first member with the rest of its group; links found are contracted. Then pairs of groups that
are not in one component yet are compared exhaustively, without those inside the pivot's component. Where a shingle would
bring about more than `hot_pairs` such comparisons (texts that share much and link with little), the classes behind it
are ordered anew: all their shingles are counted among themselves, so that what a text has for itself comes first and
what the family shares falls behind the places that can still link. On these prefixes each shingle draws a few pivots anew, round by
round, and links with them are contracted, so that a family of near copies, of which many but not all pairs link, is one
component before its pairs would be listed. What is still apart after that joins by size as well
as shingle: the larger set of a pair looks up the sizes that its place of the shingle leaves possible. The shuffle
joins on shingles are plain inner joins, whose hot keys adaptive execution splits. No bucket is collected in a
task, none is capped.

Null texts and texts without words have n_shingles 0, link with nothing and are their own component. Null
ids link like others, but name a component only if it has no other id. Repeated rows are linked to each
other. An empty table gives no rows. Other input columns are ignored, whatever their names. A text is hashed
whole in one task, with about 50 bytes of memory for each of its words; what follows works on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.llm.bytewise import mixed, slices, word_hashes
from pactlake.llm.common import bounded_broadcast, discard, row_key, spare, written
from pactlake.llm.components import components

WIDTH, PERCENT = 3, 90
#: Longs of a class's bitmap.
LONGS = 8
#: Earlier shingles by which a pair that was met before is told; pairs that are met again all the same cost only time.
EARLIER = 4
#: Comparisons at one shingle from which on its classes are ordered anew.
HOT_PAIRS = 1 << 19
#: Pivots that a shingle of the new prefixes draws in each round, and rounds at most; pairs that no round decides are all compared.
PIVOTS, ROUNDS = 4, 8
#: Sizes up to EXACT_SIZES are bands of their own, then each band is BAND_STEP times as wide as the one before.
EXACT_SIZES, BAND_STEP = 64, 1.02
#: Bytes of a row of keys, of a pair of numbers and of a row with two bitmaps in memory, at most about.
_KEY_BYTES, _PAIR_BYTES, _MAP_BYTES = 120, 80, 300


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    salts = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    nothing = np.zeros(0, np.uint64)
    for lo, hi, data, offsets in slices(texts):
        hashes, bounds = word_hashes(data, offsets)
        n = len(hashes) - width + 1
        grams = mixed(sum(hashes[i : i + n] * salts[i] for i in range(width))) if n > 0 else nothing
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield mixed(np.sum(hashes[a:b] * salts[: b - a], dtype=np.uint64, keepdims=True) ^ np.uint64(b - a))
            else:
                yield nothing


def signature(s: np.ndarray) -> bytes:
    """160 bits that equal sets share."""
    return len(s).to_bytes(4, "big") + np.array([s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], np.uint64).tobytes()


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the set's members in LONGS * 64 cells."""
    return np.packbits(np.bincount((s & np.uint64(LONGS * 64 - 1)).astype(np.int64), minlength=LONGS * 64) & 1).view(np.int64)


def sampled_share(percent: int) -> float:
    """Share of all shingles that are counted: a little more than a prefix holds."""
    return min(1.0, 0.08 + 1.1 * (1 - percent / 100))


def prefix_length(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def index_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, key, n, cid, first, tokens, parity) of every row: tokens are its smallest hashes, `first` of them below the bound."""
    bound = np.uint64(min(int(sampled_share(percent) * (1 << 64)), (1 << 64) - 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cids, firsts, tokens, parities = [], [], [], [], []
            for s in shingle_sets(batch.column(0), width):
                prefix = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                first = int(np.searchsorted(s, bound))
                n.append(len(s))
                cids.append(signature(s))
                firsts.append(first)
                tokens.append(s[: max(first, prefix)].view(np.int64))
                parities.append(bitmap(s))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(1), "key": batch.column(2), "n": pa.array(n, pa.int64()), "cid": pa.array(cids, pa.binary()), "first": pa.array(firsts, pa.int64()), "tokens": pa.array(tokens, longs), "parity": pa.array(parities, longs)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("text", "doc_id", "key").mapInArrow(index, f"doc_id {kind}, key string, n bigint, cid binary, first bigint, tokens array<bigint>, parity array<bigint>")


def classes_of(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, key, n, cid), (classes: cno, cid, key, n, first, tokens, parity): written tables."""
    found = written(index_of(docs, width, percent), "join-index")
    members = written(found.select("doc_id", "key", "n", "cid"), "join-members")
    one = found.filter("n > 0").groupBy("cid").agg(F.first(F.struct("key", "n", "first", "tokens", "parity")).alias("one"))
    classes = written(one.select(F.monotonically_increasing_id().alias("cno"), "cid", "one.*"), "join-classes")
    discard(found)
    return members, classes


def postings_of(classes: DataFrame, percent: int) -> DataFrame:
    """(cno, n, token, pos, earlier, lead, h) of the prefix shingles that more than one class holds.

    pos is 0-based, at most the true place; earlier has the last few such shingles before. lead: the class's first row.
    h is a hash of the whole prefix, null if others do not hold all of it.
    """
    entries = classes.select("cno", F.explode("tokens").alias("token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("holders")).filter("holders > 1")
    bound = int(sampled_share(percent) * (1 << 64)) - (1 << 63)  # hashes are unsigned, Spark's longs are not
    counted = F.col("token").bitwiseXOR(F.lit(-(1 << 63))) < F.lit(min(bound, (1 << 63) - 1))
    held = entries.join(shared, "token").select("cno", "token", F.when(counted, F.col("holders")).alias("holders"))
    own = Window.partitionBy("cno")
    order = own.orderBy(F.col("holders").asc_nulls_last(), "token")
    placed = held.select("cno", "token", F.count("holders").over(own).alias("known"), F.row_number().over(order).alias("nth"), F.collect_list("token").over(order.rowsBetween(-EARLIER, -1)).alias("earlier"))
    placed = placed.join(classes.select("cno", "n", "first"), "cno")
    # shingles that no other class holds come first, then shared ones below the bound, then the rest
    pos = (F.col("first") - F.col("known") + F.col("nth") - 1).cast("int")
    placed = placed.select("cno", "n", "token", pos.alias("pos"), "earlier").filter(F.col("pos") < prefix_length(F.col("n"), percent))
    whole = F.count("*").over(own) >= prefix_length(F.col("n"), percent)
    lead = F.col("pos") == F.min("pos").over(own)
    return placed.select("*", lead.alias("lead"), F.when(whole, F.bit_xor(F.xxhash64("token")).over(own)).alias("h"))


def differ(x: str, y: str) -> Column:
    """Least number of differing cells of two bitmaps' ranges (arrays x_lo, x_hi, y_lo, y_hi)."""
    at = lambda name, i: F.get(F.col(name), F.lit(i))
    return sum(F.bit_count(at(f"{x}_lo", i).bitwiseAND(F.bitwise_not(at(f"{y}_hi", i))).bitwiseOR(at(f"{y}_lo", i).bitwiseAND(F.bitwise_not(at(f"{x}_hi", i))))) for i in range(LONGS))


def sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def need(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of linked sets."""
    return F.ceil((n + m) * percent / (100 + percent))


def places_fit(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Length and position filters for sizes n, m and places pos, at of a shared shingle."""
    return sizes_fit(n, m, percent) & (F.least(n - pos, m - at) >= need(n, m, percent))


def close(x: str, y: str, percent: int) -> Column:
    """Length and bitmap filters for two sides with sizes x_n, y_n."""
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    return sizes_fit(n, m, percent) & (differ(x, y) <= n + m - 2 * need(n, m, percent))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cno, text) of one row of each wanted class (cno, key); texts compress, sets of hashes do not."""
    keys = bounded_broadcast(wanted.select("key", "cno"), _KEY_BYTES)
    return docs.select("key", "text").join(keys, "key").select("cno", "text").dropDuplicates(["cno"])


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) with `both`, the size of the intersection, and the sizes n, m of their sets."""
    left = texts.select(F.col("cno").alias("a"), F.col("text").alias("x")).join(bounded_broadcast(pairs, _PAIR_BYTES), "a")
    met = left.join(texts.select(F.col("cno").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, None
        for batch in batches:
            out, n, m = [], [], []
            for b, s, i in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2), width), range(batch.num_rows), strict=True):
                if b != last:  # pairs of a pivot come together
                    last, t = b, next(shingle_sets(batch.column(3).slice(i, 1), width))
                merged = np.sort(np.concatenate((s, t)), kind="stable")
                out.append(int((merged[1:] == merged[:-1]).sum()))
                n.append(len(s))
                m.append(len(t))
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "b": batch.column(1), "both": pa.array(out, pa.int64()), "n": pa.array(n, pa.int64()), "m": pa.array(m, pa.int64())})

    return met.mapInArrow(count, "a bigint, b bigint, both bigint, n bigint, m bigint")


def groups_of(postings: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members: cno, gid, key, n, parity), (groups: gid, n, size, lo, hi); a group is named by its first member."""
    held = postings.filter("lead").select("cno", "n", "h")
    named = held.filter("h is not null").groupBy("h", "n").agg(F.min("cno").alias("gid"))
    met = held.join(named, ["h", "n"]).select("cno", "gid")
    gids = held.filter("h is null").select("cno", F.col("cno").alias("gid")).unionByName(met)
    members = written(gids.join(classes.select("cno", "key", "n", "parity"), "cno"), "join-grouped")
    lo = F.array(*[F.bit_and(F.get("parity", F.lit(i))) for i in range(LONGS)])
    hi = F.array(*[F.bit_or(F.get("parity", F.lit(i))) for i in range(LONGS)])
    groups = written(members.groupBy("gid").agg(F.first("n").alias("n"), F.count("*").alias("size"), lo.alias("lo"), hi.alias("hi")), "join-groups")
    return members, groups


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, cid) of every row and (cid, comp) of every class: written tables."""
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows, classes = classes_of(base, width, percent)
    postings = written(postings_of(classes, percent), "join-postings")
    narrow = written(classes.select("cno", "cid", "key", "n", "parity"), "join-narrow")
    discard(classes)
    members, groups = groups_of(postings, narrow, percent)
    others = bounded_broadcast(members.filter("cno <> gid").select("cno"), _PAIR_BYTES)  # a group is met by its first member
    entries = written(postings.drop("lead", "h").join(others, "cno", "left_anti").withColumnRenamed("cno", "gid"), "join-entries")
    # ties go by a hash that differs from shingle to shingle, so that a family of texts gets many pivots
    elected = entries.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("token", "gid").alias("h"), "gid", "n")).alias("p"))
    elected = written(elected.select("token", F.col("p.gid").alias("pivot"), F.col("p.n").alias("m"), F.col("p.pos").alias("at")), "join-elected")

    def test(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of classes; only their texts are fetched."""
        met = written(pairs.select("a", "b"), "join-pairs")
        held = bounded_broadcast(met.select(F.col("a").alias("cno")).unionByName(met.select(F.col("b").alias("cno"))), _PAIR_BYTES)
        wanted = written(members.select("cno", "key").join(held, "cno", "left_semi"), "join-wanted")
        texts = written(texts_of(base, wanted), "join-texts")
        tested = overlaps(met, texts, width)
        links = written(tested.filter(F.col("both") * 100 >= (F.col("n") + F.col("m") - F.col("both")) * percent).select("a", "b"), "join-links")
        discard(met, wanted, texts)
        return links

    fits = places_fit(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), percent)
    starred = entries.join(elected, "token").filter((F.col("gid") != F.col("pivot")) & fits).select("gid", "pivot").distinct()
    inside = groups.filter("size > 1").select("gid", F.col("gid").alias("pivot"))
    sent = lambda df: bounded_broadcast(df, _MAP_BYTES)
    stars = starred.unionByName(inside).join(sent(sketched(members, "gid", "a", "x")), "gid").filter(F.col("a") != F.col("pivot"))
    links = test(stars.join(sent(sketched(members, "cno", "b", "y").withColumnRenamed("cno", "pivot")), "pivot").filter(close("x", "y", percent)))
    comp = components(links)
    named = written(members.select("cno", "gid").join(comp, F.col("cno") == F.col("id"), "left").select("cno", "gid", F.coalesce("comp", "cno").alias("comp")), "join-comps")
    spans = named.groupBy("gid").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    facts = written(groups.join(spans, "gid").select("gid", "n", "lo", F.when(F.col("size") > 1, F.col("hi")).alias("hi"), "least", "most"), "join-facts")
    current, hot = still_open(entries, facts, elected, hot_pairs)
    later = unresolved(current.join(hot, "token", "left_anti"), members, facts, named, percent)
    more = []
    if not hot.isEmpty():
        behind = bounded_broadcast(current.join(hot, "token", "left_semi").select("gid").distinct(), _PAIR_BYTES)
        classes = written(members.join(behind, "gid", "left_semi").join(named.select("cno", "comp"), "cno").select("cno", "key", "n", "parity", "comp"), "join-hot-classes")
        places = reordered(classes, texts_of(base, classes), width, percent)
        placed = apart(places, classes)
        for salt in range(ROUNDS):
            drawn = written(drawn_stars(placed, percent, salt), "join-drawn")
            if drawn.count() * comparisons(placed) <= hot_pairs:  # so many pairs are to be expected
                break
            found = test(drawn)
            if found.isEmpty():
                break
            more.append(found)
            classes = contracted(classes, found)
            discard(placed)
            placed = apart(places, classes)
        later = later.unionByName(still_apart(placed, percent))
    more.append(test(later.distinct()))
    # components of components: only what the first links left apart is gone through again
    into = joined(named, reduce(DataFrame.unionByName, more))
    by_class = narrow.join(moved(named), "cno", "left").select("cid", F.coalesce("comp", "cno").alias("comp"))
    by_class = written(by_class.join(into, "comp", "left").select("cid", F.coalesce("into", "comp").alias("comp")), "join-classes")
    discard(postings, narrow, members, groups, entries, elected, named)
    return rows, by_class


def sketched(members: DataFrame, by: str, name: str, side: str, *more: str) -> DataFrame:
    """Members as `name`, with size and bitmap named for one side of differ()."""
    return members.select(by, F.col("cno").alias(name), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_lo"), F.col("parity").alias(f"{side}_hi"), *more)


def still_open(entries: DataFrame, facts: DataFrame, elected: DataFrame, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """(entries of shingles whose groups lie in several components, shingles with more than hot_pairs comparisons among them).

    inner: the group lies whole in the component of the shingle's pivot; two inner groups need no comparison.
    """
    spans = bounded_broadcast(facts.select("gid", "least", "most"), _PAIR_BYTES)
    span = entries.join(spans, "gid").groupBy("token").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first <> last").select("token")
    major = elected.join(spans.withColumnRenamed("gid", "pivot"), "pivot").select("token", F.when(F.col("least") == F.col("most"), F.col("least")).alias("major"))
    open_ = span.join(major, "token")
    inner = F.coalesce((F.col("least") == F.col("most")) & (F.col("least") == F.col("major")), F.lit(False))
    current = entries.join(bounded_broadcast(facts.drop("n"), _MAP_BYTES), "gid").join(open_, "token")
    current = written(current.select("token", "gid", "n", "pos", "earlier", "lo", "hi", "least", "most", inner.alias("inner")), "join-current")
    load = current.groupBy("token").agg(F.count("*").alias("every"), F.count_if(~F.col("inner")).alias("outer"))
    return current, written(load.filter(F.col("every") * F.col("outer") > hot_pairs).select("token"), "join-hot")


def band(n: Column) -> Column:
    """Number of the size band of n; larger sizes never have smaller numbers."""
    return F.when(n <= EXACT_SIZES, n).otherwise(EXACT_SIZES + F.floor(F.log(n / F.lit(float(EXACT_SIZES))) / F.log(F.lit(BAND_STEP)))).cast("int")


def reordered(classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, cno, n, pos) of the shared shingles in prefixes ordered by how many of these classes hold a shingle: a written table."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_pydict({"cno": batch.column(0), "tokens": pa.array(sets, pa.list_(pa.int64()))})

    deck = written(texts.select("cno", "text").mapInArrow(spell, "cno bigint, tokens array<bigint>").select("cno", F.explode("tokens").alias("token")), "join-deck")
    holders = deck.groupBy("token").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("cno").orderBy("holders", "token")
    placed = deck.join(holders, "token").withColumn("pos", F.row_number().over(order) - 1).filter("holders > 1").join(bounded_broadcast(classes.select("cno", "n"), _PAIR_BYTES), "cno")
    placed = written(placed.filter(F.col("pos") < prefix_length(F.col("n"), percent)).select("token", "cno", "n", "pos"), "join-places")
    discard(deck)
    return placed


def apart(places: DataFrame, classes: DataFrame) -> DataFrame:
    """Places of shingles whose classes (cno, n, parity, comp) lie in several components: a written table. inside: in the largest of them."""
    placed = places.join(bounded_broadcast(classes.select("cno", "comp"), _PAIR_BYTES), "cno")
    major = placed.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"))
    placed = placed.join(major.filter("comps > 1"), "token").join(bounded_broadcast(classes.select("cno", "parity"), _MAP_BYTES), "cno").withColumn("inside", F.col("comp") == F.col("major"))
    return written(placed.select("token", "cno", "n", "pos", "comp", "parity", "inside"), "join-placed")


def comparisons(placed: DataFrame) -> float:
    """How many times more comparisons the classes behind all shingles need than PIVOTS a place; two inside the largest component need none."""
    load = placed.groupBy("token").agg(F.count("*").alias("every"), F.count_if(~F.col("inside")).alias("outer"))
    return load.agg(F.sum(F.col("every") * F.col("outer")) / F.sum("every")).first()[0] / PIVOTS if not placed.isEmpty() else 0.0


def drawn_stars(placed: DataFrame, percent: int, salt: int) -> DataFrame:
    """Pairs (a, b) in different components where b is one of PIVOTS classes that a's shingle draws; the first round has the one with the smallest place too."""
    side = lambda name, at: F.struct(F.col("cno").alias(name), F.col("n").alias("y_n"), F.col("pos").alias(at), F.col("parity").alias("y_lo"), F.col("parity").alias("y_hi"), F.col("comp").alias("y_comp"))
    draws = [F.min_by(side("b", "at"), F.xxhash64(F.lit(salt * PIVOTS + i), "token", "cno")) for i in range(PIVOTS)]
    if salt == 0:
        draws.append(F.min_by(side("b", "at"), F.struct("pos", F.xxhash64("token", "cno"))))
    pivots = placed.groupBy("token").agg(F.array_distinct(F.array(*draws)).alias("drawn")).select("token", F.inline("drawn"))
    x = placed.select("token", F.col("cno").alias("a"), F.col("n").alias("x_n"), "pos", F.col("parity").alias("x_lo"), F.col("parity").alias("x_hi"), F.col("comp").alias("x_comp"))
    fits = places_fit(F.col("x_n"), F.col("pos"), F.col("y_n"), F.col("at"), percent) & (F.col("x_comp") != F.col("y_comp"))
    return x.join(pivots, "token").filter(fits & close("x", "y", percent)).select("a", "b").distinct()


def moved(classes: DataFrame) -> DataFrame:
    """(cno, comp) of the classes that do not name their component."""
    return classes.filter("comp <> cno").select("cno", "comp")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(comp, into) of the components of classes (cno, comp) that the links (a, b) of classes connect."""
    of = lambda end: moved(classes).select(F.col("cno").alias(end), F.col("comp").alias(f"{end}_comp"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    return components(written(ends.filter("a <> b"), "join-ends")).select(F.col("id").alias("comp"), F.col("comp").alias("into"))


def contracted(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with the components that the links (a, b) leave: a written table."""
    return written(classes.join(joined(classes, links), "comp", "left").select("cno", "key", "n", "parity", F.coalesce("into", "comp").alias("comp")), "join-hot-classes")


def still_apart(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that pass all filters at one of their places, once for each place. Of a pair,
    b is the larger (or equal, then with the larger cno).

    The smaller set's shared shingles must be at least need(n, n), so its prefix is about half as long as b's.
    """
    n, pos = F.col("n"), F.col("pos")
    named = lambda df, side, name, place: df.select("token", "band", F.col("cno").alias(name), n.alias(f"{side}_n"), pos.alias(place), F.col("parity").alias(f"{side}_lo"), F.col("parity").alias(f"{side}_hi"), F.col("comp").alias(f"{side}_comp"), F.col("inside").alias(f"{side}_inside"))
    small = named(placed.filter(n - pos >= need(n, n, percent)).withColumn("band", band(n)), "x", "a", "pos")
    least = F.greatest(F.lit(1), F.floor(n * percent / 100))
    most = F.least(n, F.ceil((n - pos) * (100 + percent) / percent) - n + 1)
    large = named(placed.filter(most >= least).withColumn("band", F.explode(F.sequence(band(least), band(F.greatest(most, least))))), "y", "b", "at")
    fits = places_fit(F.col("x_n"), F.col("pos"), F.col("y_n"), F.col("at"), percent) & (F.col("x_comp") != F.col("y_comp"))
    fits = fits & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("a") < F.col("b")))) & close("x", "y", percent)
    met = lambda x, y: x.join(y, ["token", "band"]).filter(fits).select("a", "b")
    return met(small, large.filter("not y_inside")).unionByName(met(small.filter("not x_inside"), large.filter("y_inside")))


def unresolved(current: DataFrame, members: DataFrame, facts: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components whose groups share a prefix shingle of `current` and pass the group filters."""
    sent = lambda df: bounded_broadcast(df, _MAP_BYTES)
    x = current.filter("not inner").select("token", F.col("gid").alias("g"), F.col("n").alias("x_n"), "pos", "earlier", F.col("lo").alias("x_lo"), F.coalesce("hi", "lo").alias("x_hi"), F.col("least").alias("x_least"), F.col("most").alias("x_most"))
    y = current.select("token", F.col("gid").alias("h"), F.col("n").alias("y_n"), F.col("pos").alias("at"), F.col("earlier").alias("before"), F.col("lo").alias("y_lo"), F.coalesce("hi", "lo").alias("y_hi"), F.col("least").alias("y_least"), F.col("most").alias("y_most"), "inner")
    apart = (F.least("x_least", "y_least") != F.greatest("x_most", "y_most")) & ((F.col("g") < F.col("h")) | (F.col("inner") & (F.col("g") != F.col("h"))))
    fits = places_fit(F.col("x_n"), F.col("pos"), F.col("y_n"), F.col("at"), percent)
    again = F.arrays_overlap("earlier", "before")  # a pair that passes here passes at an earlier shared shingle too
    pairs = x.join(y, "token").filter(apart & fits & close("x", "y", percent) & ~again).select("g", "h").distinct()
    pairs = pairs.unionByName(facts.filter("least <> most").select(F.col("gid").alias("g"), F.col("gid").alias("h")))
    # one side's members meet the other group's bitmaps first, so that pairs that no member passes are not expanded
    other = facts.select(F.col("gid").alias("h"), F.col("n").alias("y_n"), F.col("lo").alias("y_lo"), F.coalesce("hi", "lo").alias("y_hi"), F.col("least").alias("y_least"), F.col("most").alias("y_most"))
    held = written(members.join(named.select("cno", "comp"), "cno"), "join-held")
    left = sketched(held, "gid", "a", "x", F.col("comp").alias("acomp")).withColumnRenamed("gid", "g")
    beside = (F.col("acomp") != F.col("y_least")) | (F.col("acomp") != F.col("y_most"))
    half = pairs.join(sent(other), "h").join(sent(left), "g").filter(beside & close("x", "y", percent)).drop("y_n", "y_lo", "y_hi")
    right = sketched(held, "gid", "b", "y", F.col("comp").alias("bcomp")).withColumnRenamed("gid", "h")
    each = half.join(sent(right), "h").filter((F.col("acomp") != F.col("bcomp")) & ((F.col("g") != F.col("h")) | (F.col("a") < F.col("b"))) & close("x", "y", percent))
    return each.select("a", "b")


def names_of(rows: DataFrame, by_class: DataFrame, name: Column) -> DataFrame:
    """(cid, name): the least `name` of the rows in each class's component."""
    each = rows.filter("n > 0").groupBy("cid").agg(F.min(name).alias("name"))
    each = written(by_class.join(each, "cid"), "join-named")
    best = each.groupBy("comp").agg(F.min("name").alias("best"))
    return each.select("cid", "comp").join(best, "comp").select("cid", F.col("best").alias("name"))


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Set size and component of every row; see the module's docstring."""
    rows, by_class = linked(docs, width, percent, id_col=id_col, text_col=text_col, hot_pairs=hot_pairs)
    named = rows.join(names_of(rows, by_class, F.col("doc_id")), "cid", "left")
    return named.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest doc_id; rows without shingles all stay. All columns stay."""
    rows, by_class = linked(docs, width, percent, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")
    kept = written(names_of(rows, by_class, order).select("cid", F.col("name.key").alias("kept")), "join-kept")
    key = spare(docs, "copy_key")
    dropped = written(rows.join(kept, "cid").filter("key <> kept").select(F.col("key").alias(key)).distinct(), "join-dropped")
    again = written(rows.filter("n > 0").groupBy("key").count().filter("count > 1").select(F.col("key").alias(key)), "join-again")
    discard(rows, by_class, kept)
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col))).join(bounded_broadcast(dropped, _KEY_BYTES), key, "left_anti")
    again = bounded_broadcast(again, _KEY_BYTES)
    single = keyed.join(again, key, "left_anti")
    return single.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key])).drop(key)


def oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(w) < {WIDTH} THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + {WIDTH - 1}], ' ') END AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) JOIN r USING (rid) JOIN d o ON o.rid = r.other GROUP BY d.rid, d.doc_id, n.n"""
