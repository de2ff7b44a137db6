"""Alignment of two tokenizers over the corpus, with each distinct text tokenised once.

1. Texts are shuffled whole, so that equal ones meet: each distinct text comes with its multiplicity.
2. A task tokenises and aligns its texts. Both token sequences spell the same bytes, so their ends cut the text into pieces,
   and each piece is the overlap of one A token with one B token: a link. Ends of both cut the text into groups.
   Texts are gathered into bundles of about BUNDLE links, which hold the texts' measures, their pairs of ids, and the
   pairs of the bundle weighted by multiplicity. Bundles are written to the shared folder.
3. Pairs of bundles are summed to the corpus' counts; the highest count of each B id is joined to them.
4. Each bundle asks for the counts of its own pairs (each once, so that a pair found in every text costs a row a bundle),
   gets them back and measures its texts.
5. Measures are joined to documents by the texts' SHA-256.

Token bytes: those of A are the vocabulary's entries decoded from byte level; those of B its pieces, with U+2581 as a space and
<0xHH> as a byte. A's merges run in order of ids, which makes the vocabulary a table of ranks (checked when it is read).

Defined results: null and empty texts, and texts that either tokenizer doesn't spell byte for byte (a space before them),
have no tokens: zeros and an empty string. Rows with equal or null ids are each answered. Very long texts are bundles of their own.
An empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, small_batches, written

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the pattern that parts text before A's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Links of a bundle (about), and bytes of text that are aligned at once.
BUNDLE, TEXT_BYTES = 1_000_000, 2_000_000
#: A pair of ids is a number: A's id times this and B's.
_B_IDS = 1 << 16


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _decimals(n: int, ends: bytes) -> np.ndarray:
    """For each id and each of two endings its decimal digits with the ending, filled up with zero bytes."""
    rows = [[str(i).encode() + ends[k : k + 1] for k in range(2)] for i in range(n)]
    width = max(len(x) for r in rows for x in r) if n else 1
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for r in rows for x in r), np.uint8).reshape(n, 2, width)


class Tokenizers:
    """Both tokenizers in a task, from the bytes of their files."""

    def __init__(self, a: bytes, b: bytes) -> None:
        import sentencepiece
        import tiktoken

        model = json.loads(a)
        special = {x["content"] for x in model["added_tokens"]}
        letters = _byte_letters()
        vocab = {token: i for token, i in model["model"]["vocab"].items() if token not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        if any(vocab[m] != 256 + i for i, m in enumerate(merges)) or model.get("normalizer") or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the first tokenizer's ids must be in the order of its merges, over bytes as they are")
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if len(self.b_bytes) > _B_IDS:
            raise ValueError(f"the second tokenizer has more than {_B_IDS} ids")
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = _decimals(len(self.a_bytes), b",|"), _decimals(len(self.b_bytes), b",;")

    def spelt(self, text: str) -> tuple[np.ndarray, list[int]] | None:
        """Ids of both, if both spell the text."""
        want = b" " + text.encode()
        x, y = self.a.encode_to_numpy(" " + text, disallowed_special=()), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, x.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, y)) != want:
            return None
        return x, y


@dataclass
class Aligned:
    """Texts that both tokenizers spell: links are pairs[ends[i - 1]:ends[i]]."""

    sha: list[bytes]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    ends: np.ndarray


def aligned(t: Tokenizers, shas: list[bytes], spelt: list[tuple[np.ndarray, list[int]]]) -> Aligned:
    """The alignment of texts one after the other, as if they were one; texts end where both tokenizers' tokens end."""
    n_a, n_b = (np.array([len(s[k]) for s in spelt], dtype=np.int64) for k in (0, 1))
    a, b = (np.concatenate([np.asarray(s[k], dtype=np.int64) for s in spelt]) for k in (0, 1))
    last = np.zeros(int(t.a_size[a].sum()), dtype=np.uint8)
    last[np.cumsum(t.a_size[a]) - 1] = 1
    last[np.cumsum(t.b_size[b]) - 1] |= 2
    kind = last[np.flatnonzero(last)]  # one for each link, in order
    of_a, of_b, both = kind & 1, kind >> 1, kind == 3
    pairs = a[np.cumsum(of_a, dtype=np.int64) - of_a] * _B_IDS + b[np.cumsum(of_b, dtype=np.int64) - of_b]
    ends = np.flatnonzero(of_a)[np.cumsum(n_a) - 1] + 1
    upto = np.r_[0, np.cumsum(both)]
    n_groups = np.diff(upto[np.r_[0, ends]])
    group = upto[:-1]
    group_a, group_b = group[of_a == 1], group[of_b == 1]
    # groups in order, in each first A's tokens and then B's; the last of its kind in a group ends otherwise
    width = max(t.a_text.shape[2], t.b_text.shape[2])
    line = np.zeros((len(a) + len(b), width), dtype=np.uint8)
    line[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left"), : t.a_text.shape[2]] = t.a_text[a, np.r_[group_a[1:] != group_a[:-1], True].astype(np.int8)]
    line[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right"), : t.b_text.shape[2]] = t.b_text[b, np.r_[group_b[1:] != group_b[:-1], True].astype(np.int8)]
    used = line != 0
    flat = line[used].tobytes()
    cut = np.r_[0, np.cumsum(used.sum(axis=1))][np.r_[0, np.cumsum(n_a + n_b)]]
    groups = [hashlib.sha256(flat[x : z - 1]).hexdigest() for x, z in zip(cut[:-1], cut[1:], strict=True)]
    return Aligned(shas, n_a, n_b, n_groups, groups, pairs, ends)


_tokenizers: dict[tuple[int, int], Tokenizers] = {}


def _here(a: bytes, b: bytes) -> Tokenizers:
    key = (hash(a), hash(b))
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizers(a, b)
    return _tokenizers[key]


_BUNDLE = "bundle bigint, sha array<binary>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups array<string>, pairs array<bigint>, weights array<bigint>, links binary, times binary, at array<bigint>"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte: most are small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1).astype(np.int64)


def bundled(number: int, parts: list[Aligned], times: np.ndarray) -> pa.RecordBatch:
    """One bundle; times: the texts' multiplicities."""
    n_links = np.concatenate([np.diff(np.r_[0, p.ends]) for p in parts])
    pair = np.concatenate([p.pairs for p in parts])
    text = np.repeat(np.arange(len(n_links)), n_links)
    pairs, place = np.unique(pair, return_inverse=True)
    # each pair of a text once, with how often it is there; in a text in order, so that steps are small
    key, k = np.unique(text * len(pairs) + place, return_counts=True)
    of, place = key // len(pairs), key % len(pairs)
    weights = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(weights, place, k * times[of])
    at = np.searchsorted(of, np.arange(len(n_links) + 1))
    first = np.zeros(len(place), dtype=bool)
    first[at[:-1]] = True
    steps = np.where(first, place, place - np.r_[0, place[:-1]])
    values = [number, [s for p in parts for s in p.sha], *(np.concatenate([getattr(p, c) for p in parts]) for c in ("n_a", "n_b", "n_groups")), n_links, [g for p in parts for g in p.groups], pairs, weights, _planes(steps), _planes(k), at]
    one = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in _BUNDLE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([one(v)], kinds[t]) for v, (_, t) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def bundles(texts: DataFrame, a: bytes, b: bytes, size: int = BUNDLE) -> DataFrame:
    """Bundles of distinct texts (text, times)."""
    sc = texts.sparkSession.sparkContext
    files = sc.broadcast((a, b))  # two files of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _here(*files.value)
        task, made = TaskContext.get().partitionId() << 32, 0
        parts, times, held = [], [], 0
        shas, spelt, n_bytes = [], [], 0

        def close() -> None:
            nonlocal held, shas, spelt, n_bytes
            if spelt:
                parts.append(aligned(t, shas, spelt))
                held += len(parts[-1].pairs)
            shas, spelt, n_bytes = [], [], 0

        for batch in slices(batches):
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (got := t.spelt(text)) is not None:
                    data = text.encode()
                    shas.append(hashlib.sha256(data).digest())
                    spelt.append(got)
                    times.append(n)
                    n_bytes += len(data)
                    if n_bytes >= TEXT_BYTES:
                        close()
                        if held >= size:
                            yield bundled(task + made, parts, np.array(times))
                            parts, times, held, made = [], [], 0, made + 1
        close()
        if parts:
            yield bundled(task + made, parts, np.array(times))

    return texts.select("text", "times").mapInArrow(run, _BUNDLE)


def _measured(key: tuple, bundle: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of a bundle with their measures."""
    row = bundle.to_pylist()[0]
    pairs = np.array(row["pairs"], dtype=np.int64)
    to = np.searchsorted(pairs, counts.column("pair").to_numpy())
    count, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
    count[to], best[to] = counts.column("count").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    at = np.array(row["at"], dtype=np.int64)
    steps, k = _unplanes(row["links"]), _unplanes(row["times"])
    place = np.cumsum(steps)
    place -= np.repeat(place[at[:-1]] - steps[at[:-1]], np.diff(at))
    sums = [np.add.reduceat(k * x[place], at[:-1]) for x in (best, count)]
    names = ["sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    columns = [pa.array(row["sha"], pa.binary()), *(pa.array(row[c], pa.int64()) for c in names[1:5]), pa.array(row["groups"], pa.string()), *(pa.array(s, pa.int64()) for s in sums)]
    return pa.table(columns, names=names)


def pair_counts(bundles_: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids in the corpus, and whether no pair of the B id has more."""
    rows = bundles_.select(F.explode(F.arrays_zip("pairs", "weights")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.weights").alias("weight"))
    counts = written(rows.groupBy("pair").agg(F.sum("weight").alias("count")).withColumn("b", F.col("pair") % _B_IDS), "align-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    out = written(counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best")), "align-pairs")
    discard(counts)
    return out


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str = A_PATH, b_path: str = B_PATH, bundle: int = BUNDLE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    distinct = rows.where("text is not null and text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    made = written(bundles(distinct, a, b, bundle), "align-bundles")
    counts = pair_counts(made)
    asks = made.select(F.col("bundle").alias("of"), F.explode("pairs").alias("pair"))
    answers = asks.join(counts, "pair").select("of", "pair", "count", "best")
    kind = "sha binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    measures = written(made.drop("weights").groupBy("bundle").cogroup(answers.groupBy("of")).applyInArrow(_measured, kind), "align-measures")
    discard(made, counts)
    named = rows.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("sha"))
    out = named.join(measures, "sha", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
