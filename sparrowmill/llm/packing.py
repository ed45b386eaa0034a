"""Cost-balanced packing of token ids into sequences."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowmill.llm.common import written
from sparrowmill.sources import table

PIECE = "start long, length long, doc_tokens long, ids binary"
#: Long runs of white space (Unicode's property of that name).
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def _coder(tokenizer: str) -> Callable[[str], list[int]]:
    """Ids of a text as ``tokenizers`` gives them without special tokens added.
    For a vocabulary that is also there as ranks, byte-pair encoding by ranks
    gives the same ids (a test holds them together over all characters) in a
    quarter of the time. It knows no added tokens, so texts with one in them go
    to ``tokenizers``. Nor does it bear long runs of white space: these go there,
    by themselves. The pattern takes a run before a word in one, but for its last
    character, and a run at the end whole; so no token can reach over these cuts."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer
    plain = Tokenizer.from_file(path)
    by_ranks = f"{path.removesuffix('.json')}.tiktoken"
    if not os.path.exists(by_ranks):
        return lambda text: plain.encode(text, add_special_tokens=False).ids

    import base64

    import tiktoken

    with open(by_ranks, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = [t.content for t in plain.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return plain.encode(text, add_special_tokens=False).ids
        out, at = [], 0
        for run in BLANKS.finditer(text) if len(text) >= 10_000 else ():
            end = run.end() - (run.end() < len(text))
            out += fast.encode_ordinary(text[at : run.start()])
            out += plain.encode(text[run.start() : end], add_special_tokens=False).ids
            at = end
        return out + fast.encode_ordinary(text[at:])

    return encode


def _pieces(batches: Iterator[pd.DataFrame], tokenizer: str, seq_len: int, end_id: int) -> Iterator[pd.DataFrame]:
    """Each text's ids and the end id, cut into pieces of ``seq_len`` and a rest."""
    encode = _coder(tokenizer)
    for b in batches:
        for at in range(0, len(b), 64):
            rows = []
            part = b.iloc[at : at + 64]
            for doc, text in zip(part["doc_id"], part["_text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                rows += [(doc, i, min(seq_len, len(ids) - i), len(ids), ids[i : i + seq_len].tobytes()) for i in range(0, len(ids), seq_len)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"]).astype({"doc_id": "Int64"})


def balance(lengths: list[int], seq_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, cut start, cut length, sequence, offset). Pieces go, longest first,
    to the sequence of lowest cost that has room for them; one that no sequence
    has room for is cut where the roomiest ends. The number of sequences is the
    least possible, so less than one sequence of padding is left in all."""
    bins = -(-sum(lengths) // seq_len)
    used = [0] * bins
    heap = [(0.0, i) for i in range(bins)]
    cost = [0.0] * bins
    out = []

    def place(piece: int, start: int, n: int, i: int) -> None:
        out.append((piece, start, n, i, used[i]))
        used[i] += n
        cost[i] += linear * n + quadratic * n * n

    for piece in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        start, n, passed = 0, lengths[piece], []
        while heap and seq_len - used[heap[0][1]] < n:
            passed.append(heapq.heappop(heap)[1])
        if heap:
            i = heapq.heappop(heap)[1]
            place(piece, start, n, i)
            passed.append(i)
        else:
            for i in sorted(passed, key=lambda i: (used[i], i)):
                if not n:
                    break
                if take := min(n, seq_len - used[i]):
                    place(piece, start, take, i)
                    start, n = start + take, n - take
        for i in passed:
            if used[i] < seq_len:
                heapq.heappush(heap, (cost[i], i))
    return out


def _packed(group: pd.DataFrame, seq_len: int, linear: float, quadratic: float) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "start", "_row"], kind="stable").reset_index(drop=True)
    at, cut, n, seq, offset = np.array(balance(group["length"].tolist(), seq_len, linear, quadratic), np.int64).reshape(-1, 5).T
    out = group.take(at).reset_index(drop=True)
    ids = [b[4 * c : 4 * (c + m)] for b, c, m in zip(out["ids"], cut.tolist(), n.tolist(), strict=True)]
    out = out.assign(start=out["start"] + cut, length=n, ids=ids, sequence_id=out["_group"].astype("int64") * (1 << 24) + seq, offset=offset)
    return out[["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]].astype({"doc_id": "Int64"})


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", seq_len: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_tokens: int = 200_000) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids, sequence_id, offset)``;
    ``ids`` holds little-endian 32-bit ids.

    Runs of ``seq_len`` ids fill a sequence each; the rests are dealt at random
    into groups of about ``group_tokens`` tokens and packed there by cost
    ``linear * n + quadratic * n * n``. A null or empty text is its end id
    alone; a very long one is encoded whole, in the task that has its row, and
    long runs of white space in it take no other path in their ids; repeated rows
    are packed once each; pieces of equal length go by doc_id, then start, and
    sequences of equal cost by number; a null doc_id stays null; an empty table
    gives no rows; other columns are not carried."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    cut = rows.mapInPandas(lambda it: _pieces(it, tokenizer, seq_len, end_id), f"doc_id long, {PIECE}")
    cut = written(cut.withColumn("_row", F.monotonically_increasing_id()))
    whole = cut.filter(F.col("length") == seq_len).select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("_row") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.filter(F.col("length") < seq_len)
    groups = max(1, round((rest.agg(F.sum("length")).first()[0] or 0) / group_tokens))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = f"doc_id long, {PIECE}, sequence_id long, offset long"
    packed = rest.groupBy("_group").applyInPandas(lambda g: _packed(g, seq_len, linear, quadratic), schema)
    return whole.unionByName(packed)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
