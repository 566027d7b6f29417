"""Contents sealed by a key of their agent; without the key's row nothing opens them again."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_keys(agents: DataFrame) -> DataFrame:
    """(agent_id, key) for the distinct agents of a table; write it before use, as keys are drawn anew on each evaluation."""
    salt = secrets.token_hex(32)
    return agents.select("agent_id").distinct().withColumn("key", F.unhex(F.substring(F.sha2(F.concat(F.lit(salt), F.uuid()), 256), 1, 64)))


def seal(episodes: DataFrame, keys: DataFrame) -> DataFrame:
    """content encrypted (AES-GCM, bound to the episode's id); agents without a key stay in the clear."""
    out = episodes.join(keys, "agent_id", "left")
    sealed = F.aes_encrypt(F.col("content").cast("binary"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("id").cast("binary"))
    return out.withColumn("content", F.when(F.col("key").isNotNull(), F.base64(sealed)).otherwise(F.col("content"))).withColumn("sealed", F.col("key").isNotNull()).drop("key").select(*episodes.columns, "sealed")


def unseal(sealed: DataFrame, keys: DataFrame) -> DataFrame:
    """content in the clear where its key is there; null where the agent's key is gone."""
    out = sealed.join(keys, "agent_id", "left")
    opened = F.try_aes_decrypt(F.unbase64("content"), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("id").cast("binary")).cast("string")
    return out.withColumn("content", F.when(F.col("sealed"), opened).otherwise(F.col("content"))).select(*(c for c in sealed.columns if c != "sealed"))


def shred(keys: DataFrame, agent: str) -> DataFrame:
    """The keys that are left; write them over the old ones."""
    return keys.where(F.col("agent_id") != agent)
