"""N-gram Jaccard join by universe partition and the pigeonhole principle, exact.

A document is the set of its distinct word n-grams (`words` of them; all words as one when it has fewer). Two documents link
when `den` * intersection >= `num` * union.

1. Shared n-grams. n-grams are dealt by hash to shards of bounded size, and each shard keeps those that two documents hold.
   A document that shares too few of its n-grams to reach the similarity with anything links with nothing and is left out; an
   n-gram that only one document holds counts against that document's error budget at once.
2. Signatures. Sizes fall into bands so narrow that linked documents are in the same band or in neighbouring ones. A band
   splits the universe of n-grams by hash into more segments than the largest symmetric difference a linked pair may have
   (H). If R and S link, then for any shares e_i in {0, 1, 2} that add up to H + 1 there is a segment in which they differ by
   fewer than e_i n-grams: they are equal there (e_i = 1 or 2) or one is the other less one n-gram (e_i = 2). Every document is
   indexed by its segments and their one-deletion neighbourhoods; it probes its own and the lower band, spending its shares
   where they are cheapest. The cost of a segment is bounded by the document frequency of its rarest n-gram (second rarest for
   the neighbourhood), which step 1 has counted.
3. Verification. Sets that meet in a signature are first compared with one of them, exactly. Components of the links found
   then tell which meetings are settled; sets that met but are still in different components are compared pair by pair, unless
   parity sketches show a larger difference than a link allows. So every link between different components is found, and no
   pair inside a settled group is ever made.

Equal sets are one set throughout, so copies cost nothing after step 1. Null, repeated and odd input: a text without words, or
null, is an empty set, linked with nothing; a null doc_id never is a component's name unless all its members lack one; repeated
rows keep a row each; texts are taken whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidewatch.llm.common import documents, mix64, parts_for, slices, word_hashes, words_of
from tidewatch.llm.components import connected_components
from tidewatch.session import materialise

#: n-grams that a shard may hold; a task sorts one shard in memory.
SHARD = 3_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Cost of a share on an empty segment, or on the neighbourhood of a one-token segment: it would meet almost everything.
DEAR = 1 << 40
#: Roles of a signature: of an indexed segment, an indexed deletion, a probing segment that looks for equal ones, a probing
#: segment that looks for deletions, a probing deletion.
IS_FULL, IS_DEL, ASK_FULL, ASK_DEL, DEL_ASKS = 1, 2, 4, 8, 16


class Ratio(NamedTuple):
    num: int
    den: int

    def difference(self, sizes: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to `sizes`."""
        return (self.den - self.num) * sizes // (self.den + self.num)


def shingles(hashes: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of the runs of `words` words; of the whole sequence when it is shorter."""
    n = min(words, len(hashes))
    if not n:
        return hashes
    acc = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix64(acc * STEP + hashes[i:len(hashes) - n + 1 + i])
    return np.unique(acc)


def _deal(words: int, shards: int):
    """Rows of packed n-grams per slice of documents and shard (kind 0), and of the documents themselves (kind 1)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, known = TaskContext.get().partitionId() << 32, 0, word_hashes()
        for whole in slices(batches, "text"):
            for at in range(0, whole.num_rows, 60_000):
                b = whole.slice(at, 60_000)
                batch = base + seq
                seq += 1
                sets = [shingles(known.of(words_of(t)), words) for t in b.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                h = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                prints = np.array([mix64(s).sum(dtype=np.uint64) ^ np.uint64(len(s)) for s in sets], np.uint64)
                ids = b.column("doc_id")
                out = [(batch % shards, 1, batch, ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                        ids.is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes(), sizes.astype("<i4").tobytes(), prints.tobytes())]
                shard = ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.uint32)
                order = np.argsort(shard, kind="stable")
                h, owner, shard = h[order], owner[order], shard[order]
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(h)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        docs, counts = np.unique(owner[lo:hi], return_counts=True)
                        out.append((int(shard[lo]), 0, batch, docs.tobytes(), counts.astype("<u4").tobytes(),
                                    h[lo:hi].astype("<u4").tobytes(), (h[lo:hi] >> np.uint64(32)).astype("u1").tobytes()))
                yield _packed(out)

    return run


PACKED = "shard int, kind int, batch long, a binary, b binary, c binary, d binary"
_PACKED_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PACKED_KINDS, strict=True)],
                                      [x.split()[0] for x in PACKED.split(", ")])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one shard: the n-grams that two documents hold, as 48-bit tokens with the binary logarithm of their frequency.

    Kind 1 passes through. Kind 0 comes out as documents, counts, tokens (32-bit plane, then 16-bit plane), logarithms.
    """
    rows = []
    for b in batches:
        for r in b.to_pylist():
            if r["kind"]:
                yield _packed([tuple(r.values())])
            else:
                rows.append(r)
    if not rows:
        return
    low = np.concatenate([np.frombuffer(r["c"], "<u4") for r in rows]).astype(np.uint64)
    token = low | np.concatenate([np.frombuffer(r["d"], "u1") for r in rows]).astype(np.uint64) << np.uint64(32)
    order = np.argsort(token)
    ranked = token[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    count = np.diff(np.append(first, len(ranked)))
    often = np.empty(len(token), np.uint8)
    often[order] = np.repeat(np.log2(count).astype(np.uint8) + (count > 1), count)  # 0: held once
    name = mix64(token + np.array([rows[0]["shard"] + 1], np.uint64) * STEP) >> np.uint64(16)
    at, out = 0, []
    for r in rows:
        docs, counts = np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], "<u4").astype(np.int64)
        here = slice(at, at + int(counts.sum()))
        at = here.stop
        keep = often[here] > 0
        if not keep.any():
            continue
        left = np.add.reduceat(keep.astype(np.int64), np.cumsum(counts) - counts).astype("<u4")
        tokens = name[here][keep]
        out.append((r["shard"], 0, r["batch"], docs[left > 0].tobytes(), left[left > 0].tobytes(), _planes(tokens), often[here][keep].tobytes()))
    yield _packed(out)


def _planes(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype("<u2").tobytes()


def _tokens(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


SETS = "doc_id long, n_shingles long, print long, tokens binary, often binary"


def _regroup(ratio: Ratio):
    """Rows sorted by batch: each document with its size, the fingerprint of its set, and its shared n-grams if they suffice."""
    def finish(rows: list[dict]) -> pa.RecordBatch:
        head = next(r for r in rows if r["kind"])
        ids = pa.array(np.frombuffer(head["a"], "<i8"), mask=np.frombuffer(head["b"], "u1") == 0)
        sizes, prints = np.frombuffer(head["c"], "<i4").astype(np.int64), np.frombuffer(head["d"], np.uint64).astype(np.int64)
        rest = [r for r in rows if not r["kind"]]
        tokens: list[bytes | None] = [None] * len(sizes)
        often: list[bytes | None] = [None] * len(sizes)
        if rest:
            owner = np.concatenate([np.repeat(np.frombuffer(r["a"], np.uint16), np.frombuffer(r["b"], "<u4")) for r in rest])
            name = np.concatenate([_tokens(r["c"]) for r in rest])
            log = np.concatenate([np.frombuffer(r["d"], "u1") for r in rest])
            shared = np.bincount(owner, minlength=len(sizes))
            enough = (ratio.den * shared >= ratio.num * sizes) & (sizes > 0)
            keep = enough[owner]
            owner, name, log = owner[keep], name[keep], log[keep]
            order = np.lexsort((name, owner))
            owner, name, log = owner[order], name[order], log[order]
            for i in np.flatnonzero(enough).tolist():
                here = slice(*np.searchsorted(owner, [i, i + 1]))
                tokens[i], often[i] = _planes(name[here]), log[here].tobytes()
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(prints), pa.array(tokens, pa.binary()), pa.array(often, pa.binary())],
                                          [x.split()[0] for x in SETS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["batch"] != r["batch"]:
                    yield finish(held)
                    held = []
                held.append(r)
        if held:
            yield finish(held)

    return run


class Bands:
    """Size bands: sets that link are in one band or in neighbouring ones."""

    def __init__(self, ratio: Ratio):
        self.ratio, self.low = ratio, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(self.low[-1] * ratio.den // ratio.num + 1)

    def of(self, n: int) -> int:
        return bisect_right(self.low, n) - 1

    def high(self, band: int) -> int:
        return self.low[band + 1] - 1

    def segments(self, band: int) -> int:
        """One more than the largest difference of a linked pair whose smaller set is in the band."""
        high = self.high(band)
        return self.ratio.difference(high + high * self.ratio.den // self.ratio.num) + 1


class Segments:
    """A set's tokens dealt to the segments of a band: signatures of the segments and deletions, and what shares cost."""

    def __init__(self, tokens: np.ndarray, often: np.ndarray, band: int, count: int):
        salt = mix64(np.array([band + 1], np.uint64) * STEP)[0]
        value = mix64(tokens + salt)
        where = (mix64(value ^ STEP) % np.uint64(count)).astype(np.int64)
        order = np.lexsort((often, where))
        where, value, often = where[order], value[order], often[order].astype(np.int64)
        self.size = np.bincount(where, minlength=count)
        start = np.cumsum(self.size) - self.size
        total = np.zeros(count, np.uint64)
        some = self.size > 0
        if len(where):
            total[some] = np.add.reduceat(value, start[some])
        place = mix64(np.arange(count, dtype=np.uint64) * STEP + salt)
        self.full = mix64(total + place).astype(np.int64)
        self.where, self.deleted = where, mix64(total[where] - value + place[where]).astype(np.int64)
        frequency = np.append(1 << np.minimum(often, 39), DEAR)
        last = len(where)
        self.first = frequency[np.where(some, start, last)]
        self.second = frequency[np.where(self.size > 1, np.minimum(start + 1, last), last)] + self.size

    def shares(self, need: int) -> np.ndarray:
        """The cheapest shares that add up to `need`; a second share of a segment never costs less than its first."""
        count = len(self.size)
        picked = np.argsort(np.concatenate([self.first, self.second]), kind="stable")[:need]
        return np.bincount(picked % count, minlength=count)


def set_signatures(tokens: np.ndarray, often: np.ndarray, size: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set and their roles. `tokens` are the shared ones; the other `size - len(tokens)` are in no other set."""
    own, keys, roles = bands.of(size), [], []
    for band in (own, own - 1):
        if band < 0:
            continue
        part = Segments(tokens, often, band, bands.segments(band))
        role = np.full(len(part.full), IS_FULL if band == own else 0, np.uint8)
        deleted = np.full(len(part.deleted), IS_DEL if band == own else 0, np.uint8)
        budget = bands.ratio.difference(size + min(size, bands.high(band))) - (size - len(tokens))
        if budget >= 0:
            share = part.shares(budget + 1)
            role[share > 0] |= ASK_FULL
            role[share > 1] |= ASK_DEL
            deleted[share[part.where] > 1] |= DEL_ASKS
        keys += [part.full[role > 0], part.deleted[deleted > 0]]
        roles += [role[role > 0], deleted[deleted > 0]]
    return np.concatenate(keys), np.concatenate(roles)


def _signatures(ratio: Ratio):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(ratio)
        for b in batches:
            held, rows = [], 0
            for print_, n, tokens, often in zip(*(b.column(c).to_pylist() for c in ("print", "n_shingles", "tokens", "often")), strict=True):
                key, role = set_signatures(_tokens(tokens), np.frombuffer(often, "u1"), n, bands)
                lone = (n - len(tokens) // 6) * 1000 // n
                held.append((key, np.full(len(key), lone, np.int32), np.full(len(key), print_), role))
                rows += len(key)
                if rows > 200_000:
                    yield _signature_batch(held)
                    held, rows = [], 0
            if held:
                yield _signature_batch(held)

    return run


def _signature_batch(held: list[tuple]) -> pa.RecordBatch:
    key, lone, print_, role = (np.concatenate(x) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(lone), pa.array(print_), pa.array(role.astype(np.int8))], SIGNATURES)


SIGNATURES = ["sig", "lone", "print", "role"]
#: Members of one meeting that a task holds at once; the rest of a larger one follows with the same first member.
HELD = 1_000_000
MEETINGS = "meeting long, print long, first long, role byte"


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by signature, share of n-grams in no other set, and set: the members of signatures in which a probe meets an
    indexed set. The first member has the smallest such share, which makes it the likeliest to link with the others.

    Small meetings of the same members are told once.
    """
    seen: set[int] = set()
    carry: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))
    open_first: int | None = None  # first member of a meeting of which parts were told

    def tell(sig: np.ndarray, print_: np.ndarray, role: np.ndarray, first_of: int | None, part: bool) -> pa.RecordBatch | None:
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (print_[1:] != print_[:-1])])
        at = np.flatnonzero(new)
        sig, print_, role = sig[at], print_[at], np.bitwise_or.reduceat(role, at)
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(start, len(sig)))
        has = np.bitwise_or.reduceat(role, start)
        lead = print_[start]
        if first_of is not None:
            has[0], lead[0], size[0] = 31, first_of, size[0] + 1
        if part:
            has[-1], size[-1] = 31, size[-1] + 1
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(sig))))
        h = has[group]
        keep = (((role & (ASK_FULL | DEL_ASKS)) > 0) & ((h & IS_FULL) > 0)) | (((role & IS_FULL) > 0) & ((h & (ASK_FULL | DEL_ASKS)) > 0)) \
            | (((role & ASK_DEL) > 0) & ((h & IS_DEL) > 0)) | (((role & IS_DEL) > 0) & ((h & ASK_DEL) > 0))
        keep &= size[group] > 1
        if not keep.any():
            return None
        sig, print_, role, first, group = sig[keep], print_[keep], role[keep], lead[group][keep], group[keep]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        members = np.diff(np.append(begin, len(group)))
        name = np.add.reduceat(mix64(print_.astype(np.uint64) + role.astype(np.uint64) * STEP), begin)
        tell_it = np.ones(len(begin), bool)
        for k in np.flatnonzero(members <= 32).tolist():
            x = int(name[k])
            if x in seen:
                tell_it[k] = False
            else:
                seen.add(x)
        if len(seen) > CACHE:
            seen.clear()
        out = np.repeat(tell_it, members)
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(print_[out]), pa.array(first[out]), pa.array(role[out].astype(np.int8))],
                                          ["meeting", "print", "first", "role"])

    for b in batches:
        now = (b.column("sig").to_numpy(), b.column("print").to_numpy(), b.column("role").to_numpy().astype(np.uint8))
        sig, print_, role = (np.concatenate([x, y]) for x, y in zip(carry, now, strict=True))
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig, sig[-1]))  # the last meeting may go on
        part = cut == 0 and len(sig) > HELD
        upto = len(sig) if part else cut
        if upto:
            told = tell(sig[:upto], print_[:upto], role[:upto], open_first, part)
            if part:
                open_first = int(print_[0]) if open_first is None else open_first
            else:
                open_first = None
            if told is not None:
                yield told
        carry = (sig[upto:], print_[upto:], role[upto:]) if not part else tuple(x[:0] for x in (sig, print_, role))
    if len(carry[0]) and (told := tell(*carry, open_first, False)) is not None:
        yield told


CACHE = 500_000


def _verify(ratio: Ratio):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last = [], None
            for u, v, nu, nv, tu, tv in zip(*(b.column(c).to_pylist() for c in ("u", "v", "nu", "nv", "tu", "tv")), strict=True):
                if last is None or last[0] != v:
                    last = v, _tokens(tv)
                both = len(np.intersect1d(_tokens(tu), last[1], assume_unique=True))
                if ratio.den * both >= ratio.num * (nu + nv - both):
                    out.append((u, v))
            columns = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])

    return run


def verified_links(pairs: DataFrame, sets: DataFrame, ratio: Ratio) -> DataFrame:
    """Those pairs (u, v) of sets that link."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("print").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("tokens").alias(f"t{name}"))

    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_verify(ratio), "u long, v long")


#: Words of the parity sketch of a set.
SKETCH = 8
SKETCHED = "print long, n long, s long, " + ", ".join(f"b{i} long" for i in range(SKETCH))


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, n, s and the parity, for each of 64 * SKETCH hash classes, of how many shared n-grams the set has in it."""
    for b in batches:
        blobs = [_tokens(t) for t in b.column("tokens").to_pylist()]
        bits = np.zeros((len(blobs), 64 * SKETCH), np.uint8)
        for row, t in zip(bits, blobs, strict=True):
            row[:] = np.bincount((mix64(t) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
        words = np.packbits(bits, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("print"), b.column("n_shingles"), pa.array(np.array([len(t) for t in blobs], np.int64)),
                                          *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH))],
                                         [x.split()[0] for x in SKETCHED.split(", ")])


def may_link(ratio: Ratio, a: str, b: str) -> Column:
    """False only for sets that cannot link, because of what they are known to differ in: the n-grams that no other set has, and
    a class of n-grams of which one set has an odd number and the other an even one."""
    differ = " + ".join(f"bit_count({a}.b{i} ^ {b}.b{i})" for i in range(SKETCH))
    return F.expr(f"({ratio.den + ratio.num}) * ({a}.n - {a}.s + {b}.n - {b}.s + {differ}) <= {ratio.den - ratio.num} * ({a}.n + {b}.n)")


def document_sets(docs: DataFrame, words: int, ratio: Ratio) -> DataFrame:
    """Step 1: a row per document (SETS); tokens only where a link is possible."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = parts_for(docs.sparkSession, size / 6, SHARD)  # a word has about six bytes
    dealt = plain.mapInArrow(_deal(words, shards), PACKED).repartitionById(shards, "shard").mapInArrow(_shared, PACKED)
    regrouped = dealt.repartition(shards, "batch").sortWithinPartitions("batch")
    return materialise(regrouped.mapInArrow(_regroup(ratio), SETS))


def linked_sets(sets: DataFrame, ratio: Ratio) -> DataFrame:
    """Steps 2 and 3: print, root for every set that links with another one. `sets` has one row per set."""
    signatures = sets.mapInArrow(_signatures(ratio), "sig long, lone int, print long, role byte")
    meetings = materialise(signatures.repartition("sig").sortWithinPartitions("sig", "lone", "print").mapInArrow(_meetings, MEETINGS))
    sizes = materialise(sets.select("print", "n_shingles", "tokens").mapInArrow(_sketch, SKETCHED))

    def pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
        return rows.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    met = pairs(meetings, "print", "first")
    stars = met.join(sizes.withColumnRenamed("print", "u").alias("x"), "u").join(sizes.withColumnRenamed("print", "v").alias("y"), "v").where(
        may_link(ratio, "x", "y")).select("u", "v")
    links = materialise(verified_links(stars, sets, ratio))
    roots = materialise(connected_components(links))
    # meetings whose members are not all in one component yet: the members outside their largest part meet all others
    placed = meetings.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    open_ = placed.groupBy("meeting", "root").agg(F.count("*").alias("n")).groupBy("meeting").agg(
        F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    still = materialise(placed.join(open_.select("meeting", F.col("most.root").alias("main")), "meeting").select(
        "meeting", "print", "role", "root", "main").distinct())
    still = still.join(sizes, "print")
    x, y = still.where("root <> main").alias("x"), still.alias("y")
    meets = F.expr("(x.role & 20 > 0 AND y.role & 1 > 0) OR (y.role & 20 > 0 AND x.role & 1 > 0) "
                   "OR (x.role & 8 > 0 AND y.role & 2 > 0) OR (y.role & 8 > 0 AND x.role & 2 > 0)")
    rest = x.join(y, "meeting").where(F.expr("x.root <> y.root") & meets & may_link(ratio, "x", "y")).select(F.col("x.print").alias("a"), F.col("y.print").alias("b"))
    more = verified_links(pairs(rest, "a", "b").join(met, ["u", "v"], "left_anti"), sets, ratio)
    return connected_components(links.unionByName(more)).withColumnRenamed("node", "print")


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    ratio = Ratio(num, den)
    rows = document_sets(docs, words, ratio)
    sets = materialise(rows.where("tokens IS NOT NULL").groupBy("print").agg(
        *(F.first(c).alias(c) for c in ("n_shingles", "tokens", "often"))))
    roots = linked_sets(sets, ratio)
    slim = rows.select("doc_id", "n_shingles", "print")
    empty = F.col("n_shingles") == 0
    named = slim.where(~empty).groupBy("print").agg(F.min("doc_id").alias("least")).join(roots, "print", "left").withColumn(
        "root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("print", "component_id")
    kept = slim.where(~empty).join(by_print, "print").select("doc_id", "n_shingles", "component_id")
    return kept.unionByName(slim.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))
