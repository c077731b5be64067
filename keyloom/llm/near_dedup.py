"""Near-duplicate classes by ProbMinHash signatures, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, map_columns, one_row_each, rejoin, settled, sieved, texts

#: Signature slots, and the bands that they are cut into.
SLOTS, BANDS = 192, 32
WORDS = 5
#: Bytes of text that one numpy pass may hold, over several documents or one long one.
PASS_BYTES = 1 << 19
#: Texts whose signatures a task keeps for their copies.
KNOWN = 20_000
#: Members and shingles of a band that one block may hold about, and shingles in one product of matrices.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1_000_000, 2048
#: Room for rounding in float32 sums; exact verification follows.
SLACK = 1e-3
# Odd 64-bit constants of the splitmix generator and of the polynomial hash.
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
#: A-Z lowered; ASCII that is neither letter nor digit parts words.
FOLD = np.array([b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, np.uint64(base)
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have, step = have + more, step * step
    return out


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """As _powers, from a table that grows to the longest pass so far: PASS_BYTES and one word, about."""
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(base, max(n, 1 << 14))
    return _POWERS[base][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 text, in order."""
    folded = FOLD[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], folded != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * powers(BASE, len(folded)), dtype=np.uint64)])
        return mix((running[ends] - running[starts]) * powers(INVERSE, len(folded))[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of a text's shingles of `words` words, and how often each occurs.

    A shorter text with any word is one shingle. Words are runs of letters, digits and non-ASCII characters, A-Z lowered.
    """
    data = text.encode("utf-8", "surrogatepass")
    # long texts are cut at blanks, which never lie in a word
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + PASS_BYTES)
        end = len(data) if end < 0 else end
        parts.append(word_hashes(data[at:end]))
        at = end
    each = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(each):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = min(words, len(each))
    with np.errstate(over="ignore"):
        joined = np.zeros(len(each) - n + 1, np.uint64)
        for k in range(n):
            joined = mix(joined * GOLDEN + each[k : len(each) - n + 1 + k])
    return np.unique(joined, return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle weighs 1 + ln(its count)."""
    return 1 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signatures [text, slot] of weighted sets, none of them empty.

    Each element's arrivals are a Poisson process with its weight as rate, driven by its hash alone, and
    each arrival falls into a random slot; the slot keeps the element that arrives first. Two sets agree
    in a slot with the probability Jaccard similarity of the sets. Arrivals are made in rounds, one more of
    each element that may still be first somewhere: an element is done when its last arrival is later than the
    latest slot of its set, so a set of n elements makes about n + slots * ln(slots) arrivals.
    """
    n_sets = len(sets)
    sizes = np.array([len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([weights(c) for _, c in sets])
    owner = np.repeat(np.arange(n_sets), sizes)
    first = np.full(n_sets * slots, np.inf)
    out = np.zeros(n_sets * slots, np.uint64)
    clock = np.zeros(len(element))
    state, alive = element.copy(), np.arange(len(element))
    with np.errstate(over="ignore"):
        while len(alive):
            state = state + GOLDEN
            bits = mix(state)
            clock = clock - np.log1p(-((bits >> np.uint64(12)).astype(np.float64) * 2.0**-52)) / rate
            # owners are sorted; only sets that still have elements are looked at
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            latest = first.reshape(n_sets, slots)[owner[new]].max(axis=1)
            soon = clock < latest[np.cumsum(new) - 1]
            if not soon.all():
                alive, owner, rate, clock, state, bits = (x[soon] for x in (alive, owner, rate, clock, state, bits))
            # the low 12 bits would be too few for an even choice of slots; mix again
            place = owner * slots + (mix(bits) >> np.uint64(33)).astype(np.int64) % slots
            np.minimum.at(first, place, clock)
            won = clock == first[place]
            out[place[won]] = element[alive[won]]
    return out.reshape(n_sets, slots)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit hash for each band of each signature; bands never share a hash but by chance."""
    n, slots = signature.shape
    rows = signature.reshape(n, bands, slots // bands)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (n, bands))
        for k in range(rows.shape[2]):
            out = mix(out * GOLDEN + rows[:, :, k])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard similarity of two shingle sets and their probability Jaccard similarity with weights."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    wa, wb = weights(a[1]), weights(b[1])
    x, y = wa[at_a], wb[at_b]
    # sum over shared d of 1 / sum over e of max(a_e / a_d, b_e / b_d); e splits where a_e / b_e passes a_d / b_d
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ahead = np.cumsum(x[::-1])[::-1] - x + (wa.sum() - x.sum())
    behind = np.cumsum(y) + (wb.sum() - y.sum())
    return max(plain, float((1 / (ahead / x + behind / y)).sum()))


def all_bands(sets: list[tuple[np.ndarray, np.ndarray]], bands: int = BANDS) -> list[np.ndarray]:
    """Band hashes of weighted shingle sets, and for those with repeated shingles the bands of their plain sets as well.

    Where nothing repeats both are the same. So two texts share bands by their probability Jaccard similarity, and by
    their plain Jaccard similarity just as well; a link needs either.
    """
    plain = [(k, (h, np.ones(len(h), np.int64))) for k, (h, c) in enumerate(sets) if c.max() > 1]
    hashes = band_hashes(signatures([*sets, *[s for _, s in plain]]), bands)
    out = list(hashes[: len(sets)])
    for (k, _), more in zip(plain, hashes[len(sets) :], strict=True):
        out[k] = np.union1d(out[k], more)
    return out


def _signed(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, text_md5, bands, size (number of shingles) of every document; no bands where a text has no word.

    A task signs a text once and keeps the result for its copies, of KNOWN texts at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, int]] = {}
        for batch in batches:
            ids, keys, column = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            found: dict[bytes, tuple[np.ndarray, int]] = {}
            todo: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
            held = 0

            def sign(todo=todo, found=found) -> None:
                for (key, made), hashes in zip(todo.items(), all_bands(list(todo.values()), bands), strict=True):
                    found[key] = hashes, len(made[0])
                todo.clear()

            for k, key in enumerate(keys):
                if key in known:
                    found[key] = known[key]
                elif key not in found and key not in todo:
                    made = shingles(column[k].as_py())
                    if len(made[0]):
                        todo[key] = made
                        held += len(made[0]) + 6 * SLOTS
                    else:
                        found[key] = np.zeros(0, np.int64), 0
                if held > 200_000:
                    sign()
                    held = 0
            if todo:
                sign()
            if len(known) < KNOWN:
                known.update(found)
            rows = [found[key] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64())],
                ["doc_id", "text_md5", "bands", "size"],
            )

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("text_md5"), "text")
    return rows.mapInArrow(run, "doc_id long, text_md5 binary, bands array<long>, size long")


def _candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of representatives that share a band: each with the hub, the smallest and the largest id of its bands.

    A band's hub is the member whose own bands hold the most members: in a group of copies made from one text, that text, which is near
    to all of them even where they aren't near to each other. So a band of any size gives three pairs for each member at
    most; _rest compares what these leave in different classes. Band sizes and hubs are aggregated partly before the shuffle, and the joins back may be split at large bands.
    """
    banded = reps.select("rep", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settled(rejoin(banded, sizes, ["band"]))
    degree = shared.groupBy("rep").agg(F.sum("n").alias("degree"))
    ranked = rejoin(shared.select("rep", "band"), degree, ["rep"])
    ends = ranked.groupBy("band").agg(
        F.max(F.struct("degree", (-F.col("rep")).alias("id"))).alias("hub"), F.min("rep").alias("low"), F.max("rep").alias("high")
    )
    ends = ends.select("band", F.array_distinct(F.array(-F.col("hub.id"), "low", "high")).alias("others"))
    pairs = rejoin(shared.select("rep", "band"), ends, ["band"]).select("rep", F.explode("others").alias("other")).where("rep <> other")
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _packed(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, hashes, counts: the shingles of the nodes in wanted (id); each node's text is read from a row with its smallest doc_id."""
    rows = texts(docs).withColumns({"doc_id": F.col("doc_id").cast("long"), "text_md5": F.unhex(F.md5("text"))})
    named = settled(reps.join(wanted, F.col("rep") == F.col("id")).select("id", "low_id", F.col("text_md5").alias("id_md5")))
    rows = sieved(rows, F.xxhash64("doc_id", "text_md5"), named.select(F.xxhash64("low_id", "id_md5"))).where("kl_maybe")
    held = rows.join(named, F.col("doc_id").eqNullSafe(F.col("low_id")) & (F.col("text_md5") == F.col("id_md5")))
    held = held.select("id", "text")

    def pack(batch: dict[str, list]) -> Iterator[dict[str, object]]:
        found = [shingles(t) for t in batch["text"]]
        yield {"id": batch["id"], "hashes": [h.tobytes() for h, _ in found], "counts": [c.astype("<u4").tobytes() for _, c in found]}

    return settled(map_columns(held, "id long, hashes binary, counts binary", pack).dropDuplicates(["id"]))


def _verified(packed: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose exact similarity is at least the threshold; shingles travel once to each of their pairs."""
    left = packed.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = packed.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    paired = pairs.join(left, "a").join(right, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "ha", "ca", "hb", "cb")]
            kept = []
            for k in range(batch.num_rows):
                ha, ca, hb, cb = (np.frombuffer(c[k].as_py(), kind) for c, kind in zip(columns[2:], ("<u8", "<u4") * 2, strict=True))
                if similarity((ha, ca), (hb, cb)) >= threshold:
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in columns[:2]], ["a", "b"])

    return paired.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id of it) of all ids in the edges (a, b), by alternating star contraction.

    Each round links every id to the smallest id around it, first over all larger neighbours and then over the
    smaller ones; rounds number about the logarithm of the longest chain. All steps are partial aggregations and
    joins, and a checkpoint ends each round.
    """
    links = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = links.union(links.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = rejoin(both, smallest, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        roots = large.distinct()
        low = roots.groupBy("u").agg(F.min("v").alias("m"))
        small = rejoin(roots, low, ["u"]).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = settled(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        same = after.exceptAll(links).isEmpty() and links.count() == after.count()
        links = after
        if same:
            break
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _counted(keys: list[np.ndarray], values: list[list[np.ndarray]], left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """For each (x, y) in values: the sum over shared keys of x times y, for all left and right rows, by products of incidence matrices."""
    n = len(keys)
    row = np.repeat(np.arange(n), [len(k) for k in keys])
    _, column, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times[column] > 1)
    order = often[np.argsort(column[often], kind="stable")]
    _, column = np.unique(column[order], return_inverse=True)
    width = int(column[-1]) + 1 if len(column) else 0
    sums = [np.zeros((len(left), len(right)), np.float32) for _ in values]
    for at in range(0, width, COLUMNS):
        some = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        made: dict[int, np.ndarray] = {}
        for total, pair in zip(sums, values, strict=True):
            for v in pair:
                if id(v) not in made:
                    made[id(v)] = np.zeros((n, min(COLUMNS, width - at)), np.float32)
                    made[id(v)][row[order[some]], column[some] - at] = v[order[some]]
            total += made[id(pair[0])][left] @ made[id(pair[1])][right].T
    return sums


def open_pairs(classes: np.ndarray, bands: list[np.ndarray], blocks: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the lower block and of the higher, or of the one that there is twice, and which of their pairs this band has to compare.

    A pair is compared in the smallest band that it shares, and unless it is in one class already.
    """
    left, right = (np.flatnonzero(blocks == b) for b in (blocks.min(), blocks.max()))
    need = classes[left][:, None] != classes[right][None, :]
    if blocks.min() == blocks.max():
        need &= left[:, None] < right[None, :]
    if need.any():
        earlier = [b[b < band] for b in bands]
        one = np.ones(sum(map(len, earlier)), np.float32)
        need &= _counted(earlier, [[one, one]], left, right)[0] == 0
    return left, right, need


def block_links(
    ids: np.ndarray, classes: np.ndarray, bands: list[np.ndarray], sets: list[tuple[np.ndarray, np.ndarray]], blocks: np.ndarray, band: int, threshold: float
) -> list[tuple[int, int]]:
    """Links that join classes, of all open pairs of a band's members in two blocks, or in the one that there is.

    Shared shingles, and the weight that they have in either text, are counted for all pairs at once. Both similarities
    are bounded by them: the plain one is known, and the probability Jaccard is at most the smaller share of weight that
    is shared, and the plain one where no shingle repeats. Pairs within the bounds are verified exactly.
    """
    left, right, need = open_pairs(classes, bands, blocks, band)
    if not need.any():
        return []
    root = {c: c for c in classes.tolist()}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    one = np.ones(sum(len(h) for h, _ in sets), np.float32)
    mass = np.concatenate([weights(c) / weights(c).sum() for _, c in sets]).astype(np.float32)
    shared, mass_left, mass_right = _counted([h for h, _ in sets], [[one, one], [mass, one], [one, mass]], left, right)
    sizes = np.array([len(h) for h, _ in sets], np.float32)
    repeats = np.array([c.max(initial=1) > 1 for _, c in sets])
    near = shared >= (threshold - SLACK) * (sizes[left][:, None] + sizes[right][None, :] - shared)
    weighed = (np.minimum(mass_left, mass_right) >= threshold - SLACK) & (repeats[left][:, None] | repeats[right][None, :])
    links = []
    for i, j in zip(*np.nonzero(need & (near | weighed)), strict=True):
        x, y = left[i], right[j]
        a, b = find(int(classes[x])), find(int(classes[y]))
        if a != b and similarity(sets[x], sets[y]) >= threshold:
            root[a] = b
            links.append((int(ids[x]), int(ids[y])))
    return links


def _rest(packed: DataFrame, reps: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the classes in parts (id, component): all pairs that share a band and are in different ones are compared.

    packed holds the members of all shared bands. Bands of up to three members have had all their pairs compared. A larger band with several classes is cut into blocks of
    bounded rows and shingles, and each pair of blocks is one group, so that no task holds a whole band, whatever its size.
    Members go to a group with their bands first, and with their shingles only where they have a pair to be compared in it.
    """
    sharing = reps.select(F.col("rep").alias("id"), "bands", "size").join(packed.select("id"), "id", "left_semi")
    classed = rejoin(sharing, parts, ["id"], "left").withColumn("class", F.coalesce("component", "id"))
    banded = settled(classed.select("id", "class", "size", F.explode("bands").alias("band")))
    mixed = banded.groupBy("band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"),
        F.min("class").alias("low"),
        F.max("class").alias("high"),
    )
    open_ = mixed.where("n > 3 AND low < high").select("band", "blocks")
    members = settled(rejoin(banded.select("id", "band"), open_, ["band"]))
    if members.isEmpty():
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))
    named = settled(classed.select("id", "class", "bands").join(members.select("id").distinct(), "id", "left_semi"))
    placed = members.withColumn("block", F.pmod(F.xxhash64("id", F.lit(41)), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "band", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def parts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, int]:
        ids, classes, blocks = (table.column(c).to_numpy() for c in ("id", "class", "block"))
        return ids, classes, [np.array(b, np.int64) for b in table.column("bands").to_pylist()], blocks, table.column("band")[0].as_py()

    def whole(table: pa.Table) -> bool:
        """Whether both blocks have rows."""
        return table.column("x")[0] == table.column("y")[0] or len(table.column("block").unique()) == 2

    def ask(table: pa.Table) -> pa.Table:
        asked = np.zeros(table.num_rows, bool)
        if whole(table):
            _, *rest = parts_of(table)
            left, right, need = open_pairs(*rest)
            asked[left[need.any(axis=1)]] = True
            asked[right[need.any(axis=0)]] = True
        return table.select(["id", "band", "block", "x", "y"]).filter(pa.array(asked))

    def compare(table: pa.Table) -> pa.Table:
        links = []
        if whole(table):
            ids, classes, bands, blocks, band = parts_of(table)
            held = zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)
            sets = [(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4")) for h, c in held]
            links = block_links(ids, classes, bands, sets, blocks, band, threshold)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    wanted = dealt.join(named, "id").groupBy("band", "x", "y").applyInArrow(ask, "id long, band long, block int, x int, y int")
    rows = settled(wanted).join(named, "id").join(packed, "id")
    return rows.groupBy("band", "x", "y").applyInArrow(compare, "a long, b long")


def near_classes(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, text_md5.

    Texts with equal bytes, by their 128-bit MD5, are one node; nodes are told apart by text, so documents that share an id don't
    share a class by that. Nodes whose word 5-shingles are similar by
    `threshold` or more (see similarity) are linked, and linked nodes are a class, named by its smallest doc_id, whose document
    stays (of several texts with that id, the smallest MD5). ProbMinHash with 192 slots in 32 bands misses a pair of either similarity 0.8 with probability 6e-5; bands, a divisor of 192, has
    to rise for lower thresholds: 64 bands miss a pair of 0.5 with probability 2e-4. Texts
    without a word have no shingles; only equal ones share a class. Null texts are empty. Null ids lose against any other; a class
    of null ids only has a null class_id and keeps a row all the same. Rows that repeat id and text share their fate here; drop_near_copies leaves one
    of them. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    if SLOTS % bands:
        raise ValueError(f"bands must divide {SLOTS}")
    signed = settled(_signed(docs, bands))
    node = signed.groupBy("text_md5").agg(
        F.min("doc_id").alias("low_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")
    )
    reps = settled(node.withColumn("rep", F.monotonically_increasing_id()))  # numbers that the checkpoint makes final
    pairs = settled(_candidates(reps))
    packed = _packed(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    links = _verified(packed, pairs, threshold)
    parts = settled(components(links))
    more = settled(_rest(packed, reps, parts, threshold))
    if not more.isEmpty():
        parts = components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    classes = reps.select("rep", "low_id", "copies", "text_md5").join(parts, F.col("rep") == F.col("id"), "left")
    classes = settled(classes.select("text_md5", "low_id", "copies", F.coalesce("component", "rep").alias("component")))
    first = F.min(F.struct(F.col("low_id").isNull().alias("none"), "low_id", "text_md5")).alias("first")
    named = classes.groupBy("component").agg(first, F.sum("copies").alias("class_size"))
    named = named.select("component", F.col("first.low_id").alias("class_id"), F.col("first.text_md5").alias("keep_md5"), "class_size")
    nodes = rejoin(classes, named, ["component"]).select("text_md5", "class_id", "keep_md5", "class_size")
    rows = rejoin(signed.select("doc_id", "text_md5"), nodes, ["text_md5"])
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_md5") == F.col("keep_md5"))
    return rows.select("doc_id", "class_id", "class_size", kept.alias("kept"), "text_md5")


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, bands: int = BANDS) -> DataFrame:
    """One document of each class, with all its columns as they were; see near_classes and one_row_each."""
    gone = near_classes(docs, threshold, bands).where(~F.col("kept")).select("doc_id", "text_md5").distinct()
    return one_row_each(docs, gone)
