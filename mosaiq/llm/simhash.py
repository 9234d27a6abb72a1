"""Operator 8: near duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit
word of the perfect binary Golay code. Two words at most two bits apart have a word within one
bit of both, so the codeword indices of all words within one bit of either meet: a segment has
one key, or six. Of at most two differing bits in three segments one segment has none
(pigeonhole): for each segment, its exact value joined with the next segment's fuzzy keys gives
a complete candidate search, and candidates are verified on the fingerprints.

Copies collapse to one row a fingerprint first. Keys with few fingerprints are joined pair by
pair. A key with more is searched exactly in another way: each fingerprint names the 65
fingerprints within one bit, and those that name the same one are at most two bits apart by
construction, so a star to the smallest links them; nothing is capped or dropped, and work
stays linear in the fingerprints. Components are found by alternating large and small stars.

``similar_groups`` takes a similarity of shingle sets instead. Fingerprints of the distinct shingles go
through the same Golay keys first, and the candidates are verified on the sets themselves. Fingerprints of
sets that are just similar enough lie further apart than two bits, so an exact search follows: two sets of
a similarity t share a shingle among the first n - ceil(t n) + 1 of each, in any order that is the same for
both (prefix filtering), so these shingles are keys that miss no pair; an order with frequent shingles
last keeps keys small, and no result depends on it. Texts with equal sets are one node.
Each node of a key is compared with one of the key's, and in further rounds with ``PIVOTS`` more, which
the hash of key and node picks: those that share several keys meet several. Nodes that are connected need no comparison,
so a large group is left as few links. After a first such round, more go on while the pairs that are left outnumber the
nodes ``EASY`` times, ``STARS`` rounds at most; then all of them are compared, by bounds that every similar pair
meets at the first shingle that it shares, and by their sets if these allow them. Nothing is capped, and no
result depends on the rounds.

A null text has no words, as an empty one: fingerprint zero, linked like any other. Rows with a
null id get a fingerprint and a null component (they have no id to report, and lend theirs to
none). Repeated rows give repeated results. Empty tables give no rows. Other columns are ignored.
``similar_groups`` tells rows apart by id and text, those without an id too: of a group it keeps the
smallest id, and a row without an id only if there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, scratch, trim_memory

#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
#: Segments of a fingerprint: lowest bit, bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIR_BUCKET = 24
SEED = 42
#: Rounds of stars at most before all pairs that are left, their number a node that needs no more stars.
STARS, EASY = 6, 1000
#: Nodes of a key that all others of it are compared with in a round.
PIVOTS = 8
#: Words of 64 bits of a set's parities, keys of rows (some hundred bytes each) that are sent to all at most.
PARITIES, BROADCAST_KEYS = 8, 1 << 16
#: The order of shingles is learnt from one text in ``SHARE``, from more of them in tables of under ``SAMPLE`` times
#: that many texts; frequent shingles sent to all at most (16 bytes each), texts of the sample that make one frequent.
SHARE, SAMPLE, FREQUENT, OFTEN = 5, 10_000, 1 << 20, 3


def _fingerprint(words: list[bytes], width: int):
    """Unsigned fingerprint of the ``width``-word shingles, repeats included."""
    import numpy as np
    import xxhash

    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(p, SEED) for p in parts], "<u8"))


def _majority(hashes) -> int:
    """The bits that over half of the hashes have."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def compute(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            made = [_fingerprint((t or "").encode().lower().split(), width) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(compute, "doc_id bigint, fp bigint")


def _remainder(words):
    """Of 23-bit words divided by the generator polynomial."""
    import numpy as np

    left = words.copy()
    for bit in range(22, 10, -1):
        left ^= ((left >> bit) & 1) * np.int64(GOLAY_POLYNOMIAL << (bit - 11))
    return left


def _error_patterns():
    """The error of weight three at most for each of the 2048 remainders."""
    import itertools

    import numpy as np

    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in itertools.combinations(range(23), k)], np.int64)
    table = np.empty(2048, np.int64)
    table[_remainder(errors)] = errors
    return table


def golay_keys(words, patterns=None):
    """(n, 24) codeword indices of the 23-bit words within one bit of each word."""
    import numpy as np

    patterns = _error_patterns() if patterns is None else patterns
    near = words[:, None] ^ np.concatenate(([0], np.int64(1) << np.arange(23, dtype=np.int64)))[None, :]
    return (near ^ patterns[_remainder(near)]) >> 11


def _candidate_keys(distinct: DataFrame) -> DataFrame:
    def keys(batches):
        import numpy as np
        import pyarrow as pa

        patterns = _error_patterns()
        for batch in batches:
            fps = batch["fp"].to_numpy()
            bits = fps.view(np.uint64)
            segments = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
            for k, exact in enumerate(segments):
                made = (exact[:, None] << 12 | golay_keys(segments[(k + 1) % 3], patterns)) << 2 | k
                made.sort(axis=1)
                first = np.concatenate((np.ones((len(made), 1), bool), made[:, 1:] != made[:, :-1]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(made[first]), pa.array(np.repeat(fps, first.sum(axis=1)))], ["key", "fp"])

    return distinct.mapInArrow(keys, "key bigint, fp bigint")


def link_fingerprints(distinct: DataFrame, distance: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Verified links a < b that connect what any links of at most two bits connect.

    ``distinct``: column fp without repeats. Within keys of over ``pair_bucket`` fingerprints
    the links are stars around midpoints, so chains of links are kept rather than each link.
    """
    if distance != 2:
        raise ValueError("the keys are complete for a distance of two bits")
    keys = materialise(_candidate_keys(distinct), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = sizes.filter(F.col("n") > pair_bucket).select("key")
    shared = keys.join(sizes.filter(F.col("n") <= pair_bucket).select("key"), "key", "left_semi")
    grouped = shared.groupBy("key").agg(F.collect_list("fp").alias("fps"))  # at most pair_bucket each
    one = grouped.select("fps", F.explode("fps").alias("a"))
    pairs = one.select("a", F.explode(F.expr("filter(fps, b -> a < b and bit_count(a ^ b) <= 2)")).alias("b"))
    dense = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    # all within one bit of a midpoint are within two bits of each other
    middles = dense.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")).alias("middle"))
    smallest = middles.groupBy("middle").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = middles.join(smallest, "middle").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).filter("bit_count(a ^ b) <= 2").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node that it reaches), of the nodes that have links."""
    edges = materialise(links.select("a", "b").filter("a <> b"), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(root, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialise(small.filter("u <> v").distinct().select(F.col("v").alias("a"), F.col("u").alias("b")), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of ``docs``."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    owners = materialise(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("owner")), "owners")
    roots = connected_components(link_fingerprints(owners.select("fp"), 2, pair_bucket))
    return _labelled(fps, owners, roots)


def _labelled(fps: DataFrame, owners: DataFrame, roots: DataFrame) -> DataFrame:
    groups = _owned(owners, roots).select("fp", F.col("first").alias("component_id"))
    joined = fps.join(groups, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _owned(owners: DataFrame, roots: DataFrame) -> DataFrame:
    """fp and the smallest ``owner`` in its component (``first``)."""
    placed = owners.join(roots, owners.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "owner")
    # written, so that the join can split the rows of a large component
    first = materialise(placed.groupBy("root").agg(F.min("owner").alias("first")), "component-owners")
    return placed.join(first, "root").select("fp", "first")


def shingle_set(words: list[bytes], width: int):
    """Sorted hashes of the distinct ``width``-word shingles."""
    import numpy as np
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], np.uint64))


def _of_text(text: str | None, width: int):
    """The shingle set of a text, and a hash of the set."""
    import xxhash

    found = shingle_set((text or "").encode().lower().split(), width)
    return found, xxhash.xxh64_intdigest(found.tobytes(), SEED)


def least_overlap(n: int, similarity: float) -> int:
    """Shingles that a set of ``n`` shares at least with any that similar."""
    import math

    return math.ceil(similarity * n - 1e-9)


def _prefix(found, often, counts, similarity: float):
    """Of a sorted set, the shingles that make keys; ``often``: sorted frequent ones, with ``counts``."""
    import numpy as np

    wanted = len(found) - least_overlap(len(found), similarity) + 1 if len(found) else 0
    place = np.minimum(np.searchsorted(often, found), max(0, len(often) - 1))
    known = often[place] == found if len(often) else np.zeros(len(found), bool)
    rare = found[~known][:wanted]
    if len(rare) == wanted:
        return rare
    return np.concatenate((rare, found[known][np.argsort(counts[place[known]], kind="stable")][: wanted - len(rare)]))


def _parities(found, words: int = PARITIES):
    """That many words: whether the number of shingles of each of their bits is odd."""
    import numpy as np

    bits = 64 * words
    return np.packbits(np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").view("<i8")


def _slices(batches, rows: int = 500):
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _frequent(docs: DataFrame, width: int) -> tuple:
    """Shingles of several texts of a sample, sorted, and in how many they are.

    The sample grows with the table, so the texts that an unlisted shingle is likely to have do not. Beyond
    ``FREQUENT`` shingles those of the fewest texts are left out: keys grow then, and no link is lost.
    """
    import numpy as np

    def shingles(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch["text"]:
                yield pa.RecordBatch.from_arrays([pa.array(_of_text(text.as_py(), width)[0].view(np.int64))], ["shingle"])
        trim_memory()

    every = min(SHARE, max(1, docs.count() // SAMPLE))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(shingles, "shingle bigint")
    listed = materialise(some.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN), "frequent-shingles")
    # a tally for each power of two, so that the least count to keep is found without a sort
    power = F.floor(F.log2(F.col("n")) + F.lit(1e-9))
    least, total = None, 0
    for row in listed.groupBy(power.alias("power")).agg(F.count("*").alias("shingles")).orderBy(F.desc("power")).collect():
        if (total := total + row.shingles) > FREQUENT:
            break
        least = row.power
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = listed.filter(power >= least).toArrow()
    often, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(often)
    return often[order], counts[order]


def _sets_with_keys(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, row_key, fp (a hash of the shingle set), sim (its SimHash), n, parities and keys of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    names = ["doc_id", "row_key", "fp", "sim", "n", *[f"w{k}" for k in range(PARITIES)], "keys"]

    def compute(batches):
        import numpy as np
        import pyarrow as pa

        often, counts = sent.value
        for batch in _slices(batches):
            fps, sims, sizes, words, keys = [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for text in batch["text"].to_pylist():
                found, fp = _of_text(text, width)
                fps.append(fp)
                sims.append(_majority(found))
                sizes.append(len(found))
                words.append(_parities(found))
                keys.append(_prefix(found, often, counts, similarity))
            ends = np.cumsum([len(k) for k in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))
            columns = np.concatenate(words).reshape(-1, PARITIES)
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sims)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], *longs, pa.array(sizes, pa.int64()), *[pa.array(columns[:, k].copy()) for k in range(PARITIES)], lists], names)
        trim_memory()

    schema = "doc_id bigint, row_key string, fp bigint, sim bigint, n bigint, " + "".join(f"w{k} bigint, " for k in range(PARITIES)) + "keys array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), row_key().alias("row_key"), "text").mapInArrow(compute, schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows of different ids or texts apart: null is no empty text and no id."""
    parts = (F.coalesce(F.col(doc_id).cast("bigint").cast("string"), F.lit("")), F.when(F.col(text).isNull(), "|").otherwise(":"), F.coalesce(F.col(text), F.lit("")))
    return F.md5(F.concat(*parts))


def _may_be_similar(similarity: float):
    """A condition on frames x and y of nodes that all similar pairs meet.

    Of sets with n and m shingles at most (n + m) (1 - t) / (1 + t) are in one only, and each parity
    that differs needs one of these.
    """
    n, m = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(PARITIES)), F.lit(0))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of pairs a, b of nodes those whose shingle sets are that similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", F.col("owner.row_key").alias("row_key")), "fp")
    wanted = materialise(wanted, "set-wanted")
    if wanted.count() <= BROADCAST_KEYS:  # else texts are shuffled
        wanted = F.broadcast(wanted)

    def compute(batches):
        import numpy as np
        import pyarrow as pa

        for batch in _slices(batches):
            sets = [_of_text(text, width)[0] for text in batch["text"].to_pylist()]
            wide = [_parities(s, max(PARITIES, 1 << (max(len(s), 1) - 1).bit_length() >> 6)) for s in sets]
            lists = []
            for cells, kind in ((sets, np.uint64), (wide, np.int64)):
                ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*cells, np.empty(0, kind)]).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch["fp"], *lists], ["fp", "shingles", "wide"])
        trim_memory()

    texts = docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key").select("fp", "text")
    sets = texts.mapInArrow(compute, "fp bigint, shingles array<bigint>, wide array<bigint>")
    # of repeated rows any one serves
    sets = materialise(sets.groupBy("fp").agg(F.first("shingles").alias("shingles"), F.first("wide").alias("wide")), "shingle-sets")
    pairs = materialise(_still_possible(pairs, sets, similarity), "set-pairs")
    a, b = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").filter(both >= similarity * (F.size("of_a") + F.size("of_b") - both) - 1e-6).select("a", "b")


def _still_possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs that parities in proportion to their sets allow, by the bound of ``_may_be_similar``.

    Similar sets have parities of one length or of twice the other's, which fold to half.
    """
    about = lambda x: sets.select(F.col("fp").alias(x), F.size("shingles").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}"))
    k = F.least(F.size("w_a"), F.size("w_b"))

    def folded(w):
        return F.when(F.size(w) > k, F.zip_with(F.slice(w, 1, k), F.slice(w, k + 1, k), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(w))

    unlike = F.zip_with(folded("w_a"), folded("w_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(unlike, F.lit(0), lambda n, c: n + c)
    most = (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return pairs.join(about("a"), "a").join(about("b"), "b").filter(apart <= most).select("a", "b")


def _golay_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash fingerprints are equal or link."""
    sims = materialise(nodes.groupBy("sim").agg(F.min("fp").alias("a")), "set-fingerprints")
    equal = nodes.select("sim", F.col("fp").alias("b")).join(sims, "sim").filter("a <> b").select("a", "b")
    links = link_fingerprints(sims.select(F.col("sim").alias("fp")))
    first, second = sims.select(F.col("sim").alias("a"), F.col("a").alias("x")), sims.select(F.col("sim").alias("b"), F.col("a").alias("y"))
    near = links.join(first, "a").join(second, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.unionByName(near)


def _meeting(x: DataFrame, y: DataFrame, similarity: float, more: Column) -> DataFrame:
    """Pairs a < b of a node of x and one of y that share a key, that no links connect and that may be similar.

    ``place`` is that of the key in the order of the node's shingles. At the first shingle that a pair shares no
    more than what follows it in either set is common; at later ones the bound may drop a pair that the first has given.
    """
    n, m = F.col("x.n"), F.col("y.n")
    reach = F.least(n - F.col("x.place"), m - F.col("y.place")) >= (n + m) * (similarity / (1 + similarity)) - 1e-6
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & reach & _may_be_similar(similarity)
    pairs = x.alias("x").join(y.alias("y"), met & more)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def _all_links(docs: DataFrame, found: DataFrame, nodes: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links a, b of similar nodes that connect what all links of similar nodes connect."""
    described = nodes.drop("owner", "sim")
    possible = _may_be_similar(similarity)
    # another order in each key, so that nodes that share several are compared with several
    mixed = Window.partitionBy("key").orderBy(F.xxhash64("key", "fp"), "fp")

    def verified(pairs, bounded=False):
        if not bounded:
            pairs = pairs.join(described.alias("x"), F.col("a") == F.col("x.fp")).join(described.alias("y"), (F.col("b") == F.col("y.fp")) & possible)
        with scratch(docs.sparkSession) as keep:
            pairs = materialise(pairs.select("a", "b").distinct(), "set-pairs")
            return keep(materialise(_similar(docs, nodes, pairs, width, similarity), "set-links"))

    keys = found.select("fp", F.posexplode("keys").alias("place", "key"))
    rest = materialise(keys.withColumn("pivot", F.first("fp").over(mixed)).filter("fp <> pivot").distinct(), "set-keys")
    with scratch(docs.sparkSession) as keep:
        links = keep(verified(_golay_pairs(nodes).unionByName(rest.select(F.least("pivot", "fp").alias("a"), F.greatest("pivot", "fp").alias("b"))).distinct()))
    n_nodes = nodes.count()
    for star in range(STARS):
        roots = connected_components(links).select(F.col("node").alias("fp"), F.col("root"))
        # a pivot has been compared with all of its key that it is not connected with
        rooted = materialise(rest.select("key", "place", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "set-roots")
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), ((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
        unlike = materialise(sizes.filter("roots > 1"), "set-unlike")
        if not (left := unlike.agg(F.sum("pairs")).first()[0]):
            return links
        rest = rooted.join(unlike.select("key"), "key", "left_semi")
        if star and left <= EASY * n_nodes or star + 1 == STARS:  # all pairs that no links connect yet
            told = rest.join(described, "fp")
            return links.unionByName(verified(_meeting(told, told, similarity, F.col("x.fp") < F.col("y.fp")), True))
        ranked = materialise(rest.withColumn("rank", F.row_number().over(mixed)), "set-keys")
        pivots = ranked.filter(F.col("rank") <= PIVOTS).join(described, "fp")
        # two pivots of a key meet once
        later = F.col("x.rank") > F.col("y.rank")
        links = links.unionByName(verified(_meeting(ranked.join(described, "fp"), pivots, similarity, later), True))
        rest = ranked.filter(F.col("rank") > PIVOTS).drop("rank")
    return links


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row_key, fp (a hash of the shingle set), component_id (the smallest doc_id of the group)
    and kept (the one row of its group that stays) of every row."""
    with scratch(docs.sparkSession) as keep:
        found = materialise(_sets_with_keys(docs, width, similarity), "shingle-keys")
        first = [F.first(c).alias(c) for c in ("sim", "n", *[f"w{k}" for k in range(PARITIES)])]
        # ids before none
        owner = F.struct(F.col("doc_id").isNull().alias("alone"), "doc_id", "row_key")
        nodes = materialise(found.groupBy("fp").agg(F.min(owner).alias("owner"), *first), "set-nodes")
        roots = connected_components(_all_links(docs, found, nodes, width, similarity))
        joined = found.select("doc_id", "row_key", "fp").join(_owned(nodes.select("fp", "owner"), roots), "fp")
        group = F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")).alias("component_id")
        return keep(materialise(joined.select("doc_id", "row_key", "fp", group, (F.col("row_key") == F.col("first.row_key")).alias("kept")), "similar-groups"))
