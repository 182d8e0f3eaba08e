"""Archives written by tasks and read back by ranges, against SQL on the table they were made of."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.sources import archives
from folioloom.tables import Scratch

from .base import query, table

#: Documents of an archive.
VOLUME = 200
_PATH = "'c' || doc_id % 13 || '/' || CASE WHEN doc_id % 17 = 0 THEN '._' ELSE '' END || 'p' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' WHEN 2 THEN '.txt' WHEN 3 THEN '.webp' ELSE '.jpeg' END"


def shelf(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives, written by tasks: 200 documents each, every document a member."""
    folder = Scratch(spark, "shelf").path

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in group.sort_values("doc_id", ascending=False).itertuples(index=False):
                z.writestr(zipfile.ZipInfo(r.path, (1980, 1, 1, 0, 0, 0)), r.text)
        system, inner = archives.located(folder)
        system.create_dir(inner, recursive=True)
        # one name for each archive: a task that runs again writes the same bytes
        with system.open_output_stream(f"{inner}/{key[0]}.{'Cbz' if key[0] % 2 else 'zip'}") as f:
            f.write(out.getvalue())
        return pd.DataFrame({"volume": [key[0]], "bytes": [out.tell()]})

    rows = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").selectExpr(f"doc_id div {VOLUME} AS volume", "doc_id", f"{_PATH} AS path", "coalesce(text, '') AS text")
    rows.groupBy("volume").applyInPandas(pack, "volume long, bytes long").agg(F.sum("bytes")).collect()
    return folder


@query(f"""
WITH d AS (SELECT doc_id // {VOLUME} AS volume, doc_id, {_PATH} AS path, coalesce(text, '') AS text, doc_id % 5 <> 2 AND doc_id % 17 <> 0 AS kept FROM documents WHERE doc_id IS NOT NULL)
SELECT volume, path, row_number() OVER (PARTITION BY volume ORDER BY doc_id % 13, doc_id) - 1 AS ord, strlen(text) AS length, row_number() OVER (PARTITION BY volume ORDER BY doc_id % 13, doc_id) = 1 AS is_first, sha256(text) AS digest, '' AS issue FROM d WHERE kept
UNION ALL SELECT volume, '', -1, count(*), false, '', 'skipped_non_images' FROM d WHERE NOT kept GROUP BY volume""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives in natural order, those by other names counted, each read by the task that has its range."""
    rows = archives.books(spark, shelf(spark, sf_dir))
    volume = F.regexp_extract("book_id", r"([0-9]+)\.[A-Za-z]+$", 1).cast("long")
    return rows.select(volume.alias("volume"), F.coalesce("rel_path", F.lit("")).alias("path"), F.coalesce("ord", F.lit(-1)).alias("ord"), "length", "is_first", F.coalesce(F.sha2("content", 256), F.lit("")).alias("digest"), F.coalesce("issue", F.lit("")).alias("issue"))
