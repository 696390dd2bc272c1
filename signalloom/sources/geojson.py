"""A sink of GeoJSON: each task writes one whole FeatureCollection; all of them appear at the commit, or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from signalloom.operators import listing

# The properties that map clients read of each kind of feature.
PROPERTIES = {
    "events": ["id", "ts", "source", "type", "confidence", "text", "commune", "is_confirmed_incident"],
    "incidents": ["incident_id", "code", "type", "family", "status", "title", "confidence", "confidence_level", "is_confirmed_incident", "alert_level", "commune", "event_count", "source_count", "first_seen_at", "last_seen_at"],
    "quakes": ["id", "ts", "magnitude", "depth_km", "text"],
}


@dataclass
class Written(WriterCommitMessage):
    """A task's draft and how many features it holds; no draft for a task without rows."""

    draft: str | None
    features: int


class CollectionWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _at(self) -> tuple[arrow_fs.FileSystem, str]:
        """The file system that all tasks and the driver see under this path (file, hdfs, s3)."""
        if "://" in self.path or self.path.startswith("file:"):
            return arrow_fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1))
        return arrow_fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator) -> Written:
        fs, root = self._at()
        count, out, draft = 0, None, f"{root}/_drafts-{self.job}/{uuid.uuid4().hex}"
        for row in iterator:
            if out is None:
                fs.create_dir(f"{root}/_drafts-{self.job}", recursive=True)
                out = fs.open_output_stream(draft)
                out.write(b'{"type":"FeatureCollection","features":[')
            out.write((b",\n" if count else b"\n") + row["feature"].encode())
            count += 1
        if out is None:
            return Written(None, 0)
        out.write(b"\n]}\n")
        out.close()
        return Written(draft, count)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves the drafts of the tasks that count into place; the listing of files goes last and says that they are whole."""
        fs, root = self._at()
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(arrow_fs.FileSelector(root)):
                if info.base_name.endswith(".geojson") or info.base_name == "_collections.json":
                    fs.delete_file(info.path)
        names = {}
        for k, m in enumerate(m for m in messages if m and m.draft):
            name = f"part-{k:05d}-{self.job}.geojson"
            names[name] = m.features
            fs.move(m.draft, f"{root}/{name}")
        self._clean(fs, root)
        before = {} if self.overwrite else self._listed(fs, root)
        with fs.open_output_stream(f"{root}/_collections.json") as f:
            f.write(json.dumps(before | names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of a failed job is ever seen: drafts are deleted, and those of tasks that end only later lie in a hidden folder of the job's."""
        self._clean(*self._at())

    def _clean(self, fs: arrow_fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_drafts-{self.job}").type == arrow_fs.FileType.Directory:
            fs.delete_dir(f"{root}/_drafts-{self.job}")

    @staticmethod
    def _listed(fs: arrow_fs.FileSystem, root: str) -> dict:
        if fs.get_file_info(f"{root}/_collections.json").type != arrow_fs.FileType.File:
            return {}
        with fs.open_input_stream(f"{root}/_collections.json") as f:
            return json.loads(f.read())


class Collections(DataSource):
    """Takes rows of one column, `feature`; option path."""

    @classmethod
    def name(cls) -> str:
        return "feature_collections"

    def schema(self) -> str:
        return "feature string"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options["path"], overwrite)


def write_collections(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Events, incidents or quakes as FeatureCollections, one a task; properties that the rows lack are null.

    An event is no confirmed incident, whatever it says; an incident is one where an official source confirms it.
    """
    rows = df.withColumn("is_confirmed_incident", F.col("is_official_confirmed") if kind == "incidents" else F.lit(False))
    if kind == "incidents":
        rows = listing.with_levels(rows)
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in PROPERTIES[kind] if c not in rows.columns})
    df.sparkSession.dataSource.register(Collections)
    listing.to_features(rows, PROPERTIES[kind]).select("feature").write.format("feature_collections").mode(mode).option("path", path).save()
