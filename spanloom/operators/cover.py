"""The approximate join of probes with sequences: seeds, alignment, and the cover predicate.

Probes: (probe_id, seq). Sequences: (group_id, genome_id, chr_idx, seq). Covers: keys, rc, probe_id, start, end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import windows
from spanloom.functions.kernels import exact_run, longest_around, longest_around_many
from spanloom.functions.sequences import blocks, kmers, mismatches

from .intervals import merged
from .tiling import KEYS, pieces_around

#: Rows of an index that may be broadcast (a row has a k-mer and a probe); beyond, k-mers are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _small(index: DataFrame) -> bool:
    return index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def exact_blocks(length: int, mismatches_: int) -> list[tuple[int, int]]:
    """(start, length) of mismatches + 1 blocks that tile a probe: one has no mismatch, whatever the numbers."""
    if mismatches_ >= length:
        raise ValueError("as many mismatches as letters")
    n = mismatches_ + 1
    cuts = [length * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def full_index(probes: DataFrame, k: int) -> DataFrame:
    """(kmer, probe_id, pos) of all k-mers."""
    return probes.select("probe_id", F.posexplode(kmers(F.col("seq"), k)).alias("pos", "kmer")).select("kmer", "probe_id", "pos")


def block_index(probes: DataFrame, k: int) -> DataFrame:
    """(kmer, probe_id, pos) of non-overlapping blocks."""
    return probes.select("probe_id", F.posexplode(blocks(F.col("seq"), k)).alias("i", "kmer")).select("kmer", "probe_id", (F.col("i") * k).alias("pos"))


def both_strands(seqs: DataFrame, rc_too: bool = True) -> DataFrame:
    """seqs with rc, once as they are and once reverse-complemented."""
    if not rc_too:
        return seqs.withColumn("rc", F.lit(False))
    kinds = ", ".join(f"`{c}` {t}" for c, t in seqs.dtypes)
    return seqs.mapInArrow(windows.stranded(seqs.columns), f"{kinds}, rc boolean")


def _window(seq: Column, at: Column, n: int) -> Column:
    return F.substring(seq, at + 1, F.lit(n))


def block_rows(seq: Column, length: int, mismatches_: int) -> Column:
    """Array of (b, kmer): a probe's or window's blocks."""
    return F.array(*[F.struct(F.lit(b).alias("b"), _window(seq, F.lit(a), k).alias("kmer")) for b, (a, k) in enumerate(exact_blocks(length, mismatches_))])


def first_block(length: int, mismatches_: int) -> Column:
    """Whether no block before b is alike in window and probe: of several blocks without a mismatch the first tells of the pair."""
    earlier = F.lit(False)
    for b, (a, k) in enumerate(exact_blocks(length, mismatches_)):
        earlier = earlier | ((F.col("b") > b) & (_window(F.col("window"), F.lit(a), k) == _window(F.col("probe"), F.lit(a), k)))
    return ~earlier


def hashes_of(index: DataFrame) -> dict[int, windows.Wanted] | None:
    """The hashes of the letters (b, kmer) of an index by b; None if it has more than BROADCAST_ROWS different ones.

    What comes to the driver are numbers, no more than a broadcast of that many rows has.
    """
    h = index.select("b", "kmer").mapInArrow(windows.hashing(["b"], "kmer"), "b int, h bigint, k int").select("b", "h").distinct().limit(BROADCAST_ROWS + 1).toArrow()
    if h.num_rows > BROADCAST_ROWS:
        return None
    b, h = h.column("b").to_numpy(), h.column("h").to_numpy()
    return {int(i): windows.Wanted(h[b == i].view("uint64")) for i in set(b.tolist())}


def windows_of(seqs: DataFrame, blocks: list[tuple[int, int, int]], wanted: dict[int, windows.Wanted] | None = None, *, once: bool = False) -> DataFrame:
    """(keys, rc?, b, start, window) of every place, for each kind of block b (length of the window, block's start and size).

    With ``wanted`` only windows of whose block b the hash is one of these; a few others may come, too. With ``once`` a window comes
    once (as b = 0), not for each kind of block.
    """
    keys = [*KEYS, *[c for c in ("rc",) if c in seqs.columns]]
    kinds = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in keys)
    sets = None if wanted is None else [wanted.get(b, windows.Wanted(np.zeros(0))) for b in range(len(blocks))]
    return seqs.select(*keys, "seq").mapInArrow(windows.windowing(keys, blocks, sets, once), f"{kinds}, b int, start int, window string")


def covers_full(probes: DataFrame, seqs: DataFrame, length: int, mismatches_: int = 0, *, own_group: bool = False) -> DataFrame:
    """Covers of probes of one length that match whole, with at most so many mismatches: (keys, rc?, probe_id, start, end).

    Blocks of the probes are joined with the same blocks of every window; one of them is free of mismatches,
    so none is missed. Without mismatches this is an equality join of windows. An index that is small enough is broadcast,
    windows are never shuffled, and only those whose block has a hash of the index become rows at all. With ``own_group`` probes meet sequences of their own group only.
    """
    extra = [c for c in ("rc",) if c in seqs.columns]
    group = F.col("group_id") if own_group else F.lit(0)
    index = probes.where(F.char_length("seq") == length).select(group.alias("pg"), "probe_id", F.col("seq").alias("probe"), F.explode(block_rows(F.col("seq"), length, mismatches_)).alias("x")).select("pg", "probe_id", "probe", "x.b", "x.kmer")
    small = _small(index)
    blocks = [(length, a, k) for a, k in exact_blocks(length, mismatches_)]
    wins = windows_of(seqs, blocks, hashes_of(index) if small else None).withColumnRenamed("b", "wb")
    index = F.broadcast(index) if small else index
    same = (F.col("group_id") == F.col("pg")) if own_group else F.lit(True)
    if mismatches_ == 0:
        hit = wins.join(index, (F.col("window") == F.col("probe")) & same)
    else:
        block = F.lit(None).cast("string")
        for b, (a, k) in enumerate(exact_blocks(length, mismatches_)):
            block = F.when(F.col("wb") == b, _window(F.col("window"), F.lit(a), k)).otherwise(block)
        hit = wins.withColumn("wk", block).join(index, (F.col("wb") == F.col("b")) & (F.col("wk") == F.col("kmer")) & same)
        hit = hit.where(first_block(length, mismatches_)).where(mismatches(F.col("window"), F.col("probe")) <= mismatches_)
    return hit.select(*KEYS, *extra, "probe_id", F.col("start").cast("bigint").alias("start"), (F.col("start") + length).cast("bigint").alias("end"))


def covers_whole(probes: DataFrame, seqs: DataFrame) -> DataFrame:
    """Where probes of any lengths occur whole without mismatches, merged: (keys, rc?, probe_id, start, end).

    Windows of each length that probes have are joined with the probes of that length, of windows only those with a hash of these.
    """
    keys = [*KEYS, *[c for c in ("rc",) if c in seqs.columns]]
    lengths = sorted(r[0] for r in probes.select(F.char_length("seq")).distinct().where(F.char_length("seq") > 0).collect())
    if not lengths:
        return windows_of(seqs, [(1, 0, 1)], {}).select(*keys, F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.col("start").cast("bigint").alias("start"), F.col("start").cast("bigint").alias("end")).limit(0)
    b = F.element_at(F.create_map(*[x for i, n in enumerate(lengths) for x in (F.lit(n), F.lit(i))]), F.char_length("seq"))
    index = probes.where(F.char_length("seq") > 0).select(b.alias("b"), F.col("seq").alias("kmer"), "probe_id")
    small = _small(index)
    wins = windows_of(seqs, [(n, 0, n) for n in lengths], hashes_of(index) if small else None)
    hit = wins.withColumnRenamed("window", "kmer").join(F.broadcast(index) if small else index, ["b", "kmer"])
    return merged(hit.select(*keys, "probe_id", F.col("start").cast("bigint").alias("start"), (F.col("start") + F.char_length("kmer")).cast("bigint").alias("end")), [*keys, "probe_id"])


Cover = Callable[[str, str, int, int, int, int], "tuple[int, int] | None"]


def predicate(mismatches_: int, lcf: int, island: int = 0) -> Cover:
    """The default model: the longest common stretch around the seed reaches lcf (or the whole of either), and an exact run island."""

    def covers(probe: str, seq: str, start: int, end: int, whole_probe: int, whole_seq: int) -> tuple[int, int] | None:
        n, at = longest_around(probe, seq, start, end, mismatches_)
        if n < min(lcf, whole_probe, whole_seq) or island and exact_run(probe, seq, start, end) < min(island, whole_probe, whole_seq):
            return None
        return at, at + n

    def many(apart: np.ndarray, start: np.ndarray, n: np.ndarray, size: int, whole_probe: np.ndarray, whole_seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.minimum(whole_probe, whole_seq)
        best, at = longest_around_many(apart, start, n, size, mismatches_)
        good = best >= np.minimum(lcf, whole)
        if island:
            good &= longest_around_many(apart, start, n, size, 0)[0] >= np.minimum(island, whole)
        return good, at, at + best

    covers.many = many
    #: Letters that a stretch has in common at least.
    covers.equal = lambda whole: np.minimum(lcf, whole) - mismatches_
    return covers


def whole_probe(probe: str, seq: str, start: int, end: int, whole_probe_: int, whole_seq: int) -> tuple[int, int] | None:
    """A model that takes whole probes without mismatches."""
    return (0, whole_probe_) if len(probe) == whole_probe_ and probe == seq else None


def _seeds(named: DataFrame, cover: Cover) -> windows.Seeds | None:
    """The rows (kmer, pos, probe) of a small index for the tasks that cut places: numbers and probes, no more than its broadcast has."""
    rows = named.select("pos", "probe", "kmer").mapInArrow(windows.hashing(["pos", "probe"], "kmer"), "pos int, probe string, h bigint, k int").select("h", "pos", "probe").distinct().toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    h, pos, probe = (rows.column(x).combine_chunks() for x in ("h", "pos", "probe"))
    return windows.Seeds(h.to_numpy().view(np.uint64), pos.to_numpy().astype(np.int64), probe, cover.equal)


def covers_seeded(probes: DataFrame, seqs: DataFrame, index: DataFrame, k: int, cover: Cover, *, merge: bool = True, own_group: bool = False) -> DataFrame:
    """Covers found by extending k-mer seeds: (keys, rc?, probe_id, start, end), merged or as distinct ranges.

    An index that is small enough is broadcast with its probes: an Arrow task cuts only the places whose k letters have a hash of
    the index, with the letters around them as far as the longest probe reaches; a model with ``equal`` (as ``predicate``) lets it leave out places
    at which no probe has so many equal letters. Else k-mers are taken from pieces of the sequences
    that know these letters, and joined by a shuffle; whole sequences are never joined. A model with ``many`` (as ``predicate``) is asked for many seeds at once.
    """
    extra = [c for c in ("rc",) if c in seqs.columns]
    keys = [*KEYS, *extra]
    group = [F.col("group_id").alias("pg")] if own_group else [F.lit(0).alias("pg")]
    probes_ = probes.select("probe_id", F.col("seq").alias("probe"), *group)
    reach = probes_.agg(F.coalesce(F.max(F.char_length("probe")), F.lit(1))).first()[0]
    named = index.join(probes_, "probe_id").select("pg", "kmer", "pos", "probe_id", "probe")
    on = F.col("word") == F.col("kmer")
    on = on & (F.col("group_id") == F.col("pg")) if own_group else on
    if _small(named):
        wanted = hashes_of(named.select(F.lit(0).alias("b"), "kmer")).get(0, windows.Wanted(np.zeros(0)))
        seeds = _seeds(named, cover) if hasattr(cover, "equal") else None
        kinds = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in keys)
        cut = seqs.select(*keys, "seq").mapInArrow(windows.seeding(keys, k, int(reach), wanted, seeds), f"{kinds}, i int, n int, lead int, part string")
        rows = cut.withColumn("word", F.substring("part", F.col("lead") + 1, F.lit(k))).join(F.broadcast(named), on).withColumn("from", F.col("i"))
    else:
        cut = pieces_around(seqs.select(*keys, "seq"), int(reach))
        last = F.least(F.col("size") - 1, F.col("n") - k - F.col("from"))
        at = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((F.col("from") + j).alias("i"), F.substring("part", F.col("lead") + j + 1, F.lit(k)).alias("word")))).otherwise(F.array().cast("array<struct<i:int,word:string>>"))
        place = ["from", *keys]
        hits = cut.select(*place, F.explode(at).alias("x")).select(*place, "x.*").join(named, on).select(*place, "i", "pos", "probe_id", "probe")
        rows = hits.join(cut, place)
    left = F.greatest(F.lit(0), F.col("i") - F.col("pos"))
    over = F.greatest(F.lit(0), F.col("pos") - F.col("i"))
    window = F.substring("part", left - F.col("from") + F.col("lead") + 1, F.char_length("probe") - over)
    rows = rows.select(*keys, "probe_id", left.cast("bigint").alias("left"), F.substring("probe", over + 1, F.char_length("probe")).alias("cut"), window.alias("window"), (F.col("i") - left).cast("int").alias("s"), F.char_length("probe").alias("np"), F.col("n").alias("ns"))
    kinds = rows.schema

    def several(b: pa.RecordBatch) -> pa.RecordBatch:
        probe, seq = b.column(b.schema.get_field_index("cut")), b.column(b.schema.get_field_index("window"))
        left_, s, np_, ns = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("left", "s", "np", "ns"))
        sizes = [pc.utf8_length(c).to_numpy() for c in (probe, seq)]
        m, width = np.minimum(*sizes), int(max(x.max() for x in sizes))
        good, a, z = cover.many(windows.padded(probe, width) != windows.padded(seq, width), s, m, k, np_, ns)
        good &= s + k <= m
        idx = pa.array(np.flatnonzero(good))
        return pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)).take(idx) for c in [*keys, "probe_id"]], pa.array((left_ + a)[good]), pa.array((left_ + z)[good])], names=[*keys, "probe_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if hasattr(cover, "many"):
                if len(b):
                    yield several(b)
                continue
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("left", "cut", "window", "s", "np", "ns")]
            keep, starts, ends = [], [], []
            for at, (left_, probe, seq, s, np_, ns) in enumerate(zip(*cols, strict=True)):
                m = min(len(probe), len(seq))
                got = cover(probe[:m], seq[:m], s, s + k, np_, ns) if s + k <= m else None
                if got:
                    keep.append(at)
                    starts.append(left_ + got[0])
                    ends.append(left_ + got[1])
            idx = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(idx) for c in [*keys, "probe_id"]], pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*keys, "probe_id", "start", "end"])

    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in [*keys, "probe_id"])
    hit = rows.mapInArrow(run, f"{ddl}, start bigint, end bigint").distinct()
    return merged(hit, [*keys, "probe_id"]) if merge else hit


def extended(covers: DataFrame, seqs: DataFrame, by: int) -> DataFrame:
    """Covers longer by so much on both sides, within their chromosome."""
    n = seqs.select(*KEYS, F.char_length("seq").cast("bigint").alias("n_"))
    rest = [c for c in covers.columns if c not in ("start", "end")]
    return covers.join(n, list(KEYS)).select(*rest, F.greatest(F.lit(0).cast("bigint"), F.col("start") - by).alias("start"), F.least(F.col("n_"), F.col("end") + by).alias("end"))


def in_genome(covers: DataFrame, seqs_with_offset: DataFrame) -> DataFrame:
    """Covers in coordinates of the genome, all chromosomes in order."""
    at = seqs_with_offset.select(*KEYS, "offset")
    rest = [c for c in covers.columns if c not in ("start", "end", "chr_idx")]
    return covers.join(at, list(KEYS)).select(*rest, (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
