"""The versioned JSON payload of scored changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import __version__

SCHEMA_VERSION = 5


def _reasons(column: str | Column) -> Column:
    return F.transform(column, lambda r: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["points"].alias("points"), r["detail"].alias("detail"), r["path"].alias("path")))


def payloads(changes: DataFrame, impact: DataFrame | None = None, key: str = "sha", mode: str = "scan", method: str = "rules") -> DataFrame:
    """(key, payload): one JSON document per change; nulls are written, not dropped."""
    files = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["score"].alias("score"), f["band"].alias("band"), f["lines_added"].alias("lines_added"), f["lines_deleted"].alias("lines_deleted"), _reasons(f["reasons"]).alias("reasons")))
    scope = F.struct(F.lit(mode).alias("mode"), F.col("author").alias("author"), F.date_format("when_local", "yyyy-MM-dd'T'HH:mm:ss").alias("analyzed_at"), F.size("files").alias("files_analyzed"), F.lit(None).cast("string").alias("model"))
    # "Not looked at" differs from "nothing depends on it".
    unseen = F.struct(F.lit(False).alias("analyzed"), F.lit(0).alias("direct_count"), F.lit(0).alias("transitive_count"))
    blast = F.to_json(unseen)
    rows = changes
    if impact is not None:
        rows = changes.join(impact.select(key, F.to_json(F.struct(F.lit(True).alias("analyzed"), *(c for c in impact.columns if c != key)), {"ignoreNullFields": "false"}).alias("_blast")), key, "left")
        blast = F.coalesce("_blast", blast)
    body = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(__version__).alias("engine_version"), F.lit(method).alias("scoring_method"), "score", "band", "recommendation", scope.alias("scope"),
        _reasons("reasons").alias("reasons"), files.alias("files"), F.lit(None).cast("string").alias("ai_explanation"), F.array().cast("array<string>").alias("warnings"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    # The impact is JSON already; it goes in before the last brace.
    return rows.select(key, F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"blast_radius":'), blast, F.lit("}")).alias("payload"))


def nothing(scope: dict, warnings: list[str]) -> dict:
    """The payload of a scope without files."""
    return {
        "schema_version": SCHEMA_VERSION, "engine_version": __version__, "scoring_method": "rules", "score": 0, "band": "low", "recommendation": "Nothing to score — no files in scope.",
        "scope": scope, "reasons": [], "files": [], "blast_radius": {"analyzed": False, "direct_count": 0, "transitive_count": 0}, "ai_explanation": None, "warnings": warnings,
    }
