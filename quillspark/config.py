"""Settings of the engine; ``spark.quillspark.<name>`` in the session overrides a field."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 100
    embedding_model: str = "hashed-ngrams"
    embedding_dim: int = 256
    top_k: int = 5
    temperature: float = 0.0
    max_tokens: int = 1024
    mitigation_enabled: bool = False
    hallucination_threshold: float = 0.8
    judge_prompt_version: str = "v1"
    generator_model: str = "extractive"
    judge_model: str = "overlap"


def settings(spark: SparkSession) -> Settings:
    """Defaults with the session's overrides."""
    base = Settings()
    given = {f.name: type(getattr(base, f.name))(v) for f in fields(base) if (v := spark.conf.get(f"spark.quillspark.{f.name}", None)) is not None}
    return replace(base, **given)
