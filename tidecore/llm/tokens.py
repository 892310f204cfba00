"""Texts as token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidecore.llm.memory import lean

# Closes every text.
END_ID = 0
# Texts of one Arrow batch that are encoded at a time.
STEP = 512


@cache
def encoder(vocabulary: str):
    """The vocabulary of ``byte_bpe_50k.json`` as ranks: the same ids as ``tokenizers`` gives, sooner.

    ``<|endoftext|>`` in a text is that token, as ``tokenizers`` reads it by default.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def token_lists(texts: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``(u, text)`` to ``(u, neighbours)``: the ids of each whole text and a closing id 0; null is empty."""

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            for i in range(0, len(batch), STEP):
                part = batch.slice(i, STEP)
                ids = []
                for text in part["text"].to_pylist():
                    own = encode(text or "", allowed_special="all")
                    own.append(END_ID)
                    ids.append(np.array(own, np.int32))
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.record_batch([part["u"], lists], names=["u", "neighbours"])

    return texts.mapInArrow(lean(run), T.StructType([T.StructField("u", texts.schema["u"].dataType), T.StructField("neighbours", T.ArrayType(T.IntegerType()))]))


def with_crc(pieces: DataFrame) -> DataFrame:
    """Replace ``entries`` by their CRC-32, ``ids_crc32``."""

    def run(batches):
        for batch in batches:
            crc = [zlib.crc32(x.as_buffer()) for x in batch["entries"]]
            rest = [batch[c] for c in names]
            yield pa.record_batch([*rest, pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    names = [c for c in pieces.columns if c != "entries"]
    kind = T.StructType([pieces.schema[c] for c in names] + [T.StructField("ids_crc32", T.LongType())])
    return pieces.select(*names, "entries").mapInArrow(lean(run), kind)
