"""The model seam: an injected chat function over batches of prompts, and replies read as fields."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.session import arrow_pass


def infer(rows: DataFrame, key: str, prompt: Column, chat: Callable[[list[str]], list[str]], fields: list[str]) -> DataFrame:
    """``key``, ok, and a text column per field of each reply.

    ``chat`` gets a batch of prompts and gives as many replies; it runs on the executors. A reply
    counts if it is a JSON object, bare or in a code fence; its values become field texts, and
    what is blank, a null word, a list or an object becomes null.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = chat(batch.column("prompt").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(replies, pa.string())], names=[key, "reply"])

    asked = arrow_pass(rows.select(key, F.coalesce(prompt, F.lit("")).alias("prompt")), run, f"{key} {kind}, reply string")
    body = F.try_parse_json(F.col("body"))
    value = lambda name: S.coerce_json(F.to_json(F.try_variant_get(body, f"$.{name}", "variant"))).alias(name)
    return asked.withColumn("body", S.json_reply(F.col("reply"))).select(key, F.col("body").isNotNull().alias("ok"), *map(value, fields))
