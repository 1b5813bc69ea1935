"""Observation logs: every line a record, a comment or blank; bad lines become diagnostics, never failures.

The same expressions read a batch of files and a stream of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.units import instant, is_id, real

#: The fields of an observation after its tag, in order.
OBS = ["id", "at", "frame", "x", "y", "z", "method", "fix", "h_precision", "v_precision", "antenna", "session"]
_REALS = {"x", "y", "z", "h_precision", "v_precision", "antenna"}
_IDS = {"id", "frame", "method", "fix", "session"}
_RETIRE = r'^retire[ \t]+(\S+)[ \t]+(\S+)[ \t]+(\S+)[ \t]+"((?:[^"\\]|\\["\\])*)"$'


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line, text) of all ``.obs`` files of a tree; a last line without its line feed is marked by ``open``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obs").option("recursiveFileLookup", True).load(root)
    text = F.decode("content", "UTF-8")
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("at", "text"), F.length(text).alias("n"), F.size(F.split(text, "\n")).alias("lines"))
    last = F.col("at") == F.col("lines") - 1
    return lines.where(~last | (F.col("text") != "")).select("path", (F.col("at") + 1).alias("line"), "text", last.alias("open"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")


def parsed(lines: DataFrame) -> DataFrame:
    """Adds ``form``, the fields of either form, and ``fault`` (null for a good line); comments and blank lines go.

    ``lines`` has a column ``text`` and any others.
    """
    body = _trimmed(F.col("text"))
    rows = lines.withColumn("body", body).where("body <> '' and not startswith(body, '#')")
    parts = F.split("body", r"[ \t]+")
    rows = rows.withColumns({"parts": parts, "form": F.split("body", r"[ \t]+")[0]})
    obs, retire = F.col("form") == "obs", F.col("form") == "retire"
    field = {n: F.when(obs, F.get("parts", F.lit(k + 1))) for k, n in enumerate(OBS)}
    retired = [F.regexp_extract("body", _RETIRE, k) for k in (1, 2, 3, 4)]
    shaped = F.col("body").rlike(_RETIRE)
    columns = {n: real(field[n]) if n in _REALS else field[n] for n in OBS if n not in ("id", "at")}
    columns |= {
        "id": F.coalesce(field["id"], F.when(retire & shaped, retired[0])),
        "at_text": F.coalesce(field["at"], F.when(retire & shaped, retired[1])),
        "supersedes": F.when(retire & shaped, retired[2]),
        "reason": F.when(retire & shaped, F.regexp_replace(retired[3], r'\\(["\\])', "$1")),
    }
    rows = rows.withColumns(columns).withColumn("at", instant(F.col("at_text")))
    bad_ids = F.lit(False)
    for n in sorted(_IDS):
        bad_ids = bad_ids | ~is_id(F.col(n))
    bad_reals = F.lit(False)
    for n in sorted(_REALS):
        bad_reals = bad_reals | F.col(n).isNull()
    offsetless = F.col("at_text").rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?(-00:00)?$")
    fault = (
        F.when(F.col("text").endswith("\r"), "a carriage return before the line feed")
        .when(~obs & ~retire, F.concat(F.lit("unknown form "), F.col("form")))
        .when(obs & F.col("body").contains('"'), "only a reason is quoted")
        .when(obs & (F.size("parts") != len(OBS) + 1), F.concat(F.lit("obs takes 12 fields, not "), (F.size("parts") - 1).cast("string")))
        .when(retire & ~shaped, 'retire takes an id, a time, an id and a quoted reason')
        .when(retire & (F.col("reason") == ""), "an empty reason")
        .when(offsetless, "an ambiguous timestamp: no offset")
        .when(F.col("at").isNull(), "not a timestamp")
        .when(obs & bad_ids, "not an id")
        .when(retire & ~(is_id(F.col("id")) & is_id(F.col("supersedes"))), "not an id")
        .when(obs & bad_reals, "not a real number")
        .when(obs & ((F.col("h_precision") < 0) | (F.col("v_precision") < 0) | (F.col("antenna") < 0)), "a negative precision or height")
    )
    return rows.withColumn("fault", fault).drop("body", "parts")


def observations(records: DataFrame) -> DataFrame:
    return records.where("form = 'obs' and fault is null").drop("supersedes", "reason", "form", "fault")


def retirements(records: DataFrame) -> DataFrame:
    keep = [c for c in ("path", "line") if c in records.columns]
    return records.where("form = 'retire' and fault is null").select("id", "at", "at_text", "supersedes", "reason", *keep)


def diagnostics(records: DataFrame) -> DataFrame:
    return records.where("fault is not null").select("path", "line", F.lit("error").alias("severity"), F.col("fault").alias("message"))


def linked(links: DataFrame, records: DataFrame) -> DataFrame:
    """Observations of the files that entities (entity, file) name; only those files' lines are read."""
    return records.join(links.select("entity", F.col("file").alias("path")), "path")
