"""A user's own match history: the tables' schemas, and a reader and writer of them as Parquet or CSV."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables' columns, in order.  Times are kept as the text that they came as.
SCHEMAS = {
    "settings": "key string, value string",
    "heroes": "id long, name string, role string",
    "maps": "id long, name string, mode string",
    "ranks": "id long, tier string, division int, ordinal int, name string",
    "players": "id long, display_name string, first_seen string, last_seen string, games_seen long, notes string, notes_updated_at string",
    "player_nameplates": "id long, player_id long, phash string, width_px int, first_seen string, times_matched long",
    "matches": "id long, played_at string, map_id long, mode string, result string, team_size int, duration_seconds int, rank_range_low long, rank_range_high long, notes string, created_at string, season_id long",
    "match_players": "id long, match_id long, player_id long, team string, is_me boolean, role string, hero_id long, eliminations long, assists long, deaths long, damage long, healing long, mitigation long, row_index int",
    "match_bans": "id long, match_id long, hero_id long, slot_index int",
    "match_sources": "id long, match_id long, file_path string, file_sha256 string, kind string, ingested_at string",
    "field_provenance": "id long, table_name string, row_id long, column_name string, source string, confidence double, superseded_value string",
    "drafts": "id long, created_at string, updated_at string, status string, payload string, committed_match_id long",
    "tags": "code string, tag_set string, color string, label string, sort_order int",
    "player_tags": "player_id long, tag_code string, created_at string",
    "seasons": "id long, name string, starts_on string, ends_on string, notes string, created_at string",
    "hero_portraits": "id long, hero_id long, phash string, first_seen string, times_matched long",
}
#: Vocabularies, which commits never change, with their key: seeding adds only rows whose key is new.
SEEDED = {"heroes": "name", "maps": "name", "ranks": "ordinal", "tags": "code"}


@dataclass
class Store:
    """The tables of one folder, with the same attributes as the fixture's; operators take either.

    A table lies in ``<folder>/<name>`` until a commit publishes another version of it.  Each publication has a numbered manifest with
    the place of every table; readers follow the last one, so they see all of a publication or nothing of it.
    """

    spark: SparkSession
    folder: str
    form: str = "parquet"  #: or "csv", with a header

    def _files(self, *parts: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of the last manifest, 0 without one."""
        fs, path = self._files("_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0)

    def manifest(self) -> dict:
        n = self.version()
        return json.loads(self.spark.read.text(f"{self.folder}/_manifests/{n:09d}.json", wholetext=True).first()[0]) if n else {"tables": {}, "marks": {}}

    def places(self) -> dict[str, str]:
        """Where published tables lie, by name, below the folder."""
        return self.manifest()["tables"]

    def marks(self) -> dict[str, int]:
        """What publishers noted beside the tables, such as how far a stream has come."""
        return self.manifest()["marks"]

    def read(self, name: str) -> DataFrame:
        """A table by its declared schema.  Columns that the file lacks are null, others are not read; a table without a file is empty."""
        options = {"header": True} if self.form == "csv" else {}
        place = self.places().get(name, name)
        if not (found := self._files(place))[0].exists(found[1]):
            return self.spark.createDataFrame([], SCHEMAS[name])
        raw = self.spark.read.format(self.form).options(**options).load(f"{self.folder}/{place}")
        cols = (field.strip().split(" ") for field in SCHEMAS[name].split(","))
        return raw.select(*((F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in cols))

    def write(self, name: str, df: DataFrame, place: str | None = None) -> None:
        options = {"header": True} if self.form == "csv" else {}
        df.write.format(self.form).options(**options).mode("errorifexists").save(f"{self.folder}/{place or name}")

    def publish(self, tables: dict[str, DataFrame], after: int | None = None, marks: dict[str, int] | None = None) -> int:
        """Writes new versions of ``tables`` and makes them those that are read, all at once; returns the publication's number.

        With ``after``, the version that ``tables`` were made from, nothing is published if another has come since.  ``marks`` are published with them.  The number is claimed
        while writing, so two can't publish at once.  What was written by a publication that failed is read by nobody.
        """
        if after is not None and self.version() != after:
            raise RuntimeError(f"version {after} is no longer the last one")
        number, now, mark = self.version() + 1, self.manifest(), uuid.uuid4().hex
        fs, claim = self._files("_manifests", f"{number:09d}.claim")
        if not fs.exists(claim.getParent()):
            fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            raise RuntimeError(f"another publication {number} is under way; if it failed, remove {claim}")
        try:
            for name, df in tables.items():
                self.write(name, df, f"_versions/{number:09d}-{mark}/{name}")
                now["tables"][name] = f"_versions/{number:09d}-{mark}/{name}"
            fs, draft = self._files("_manifests", f"{mark}.draft")
            stream = fs.create(draft)
            stream.write(bytearray(json.dumps({"tables": now["tables"], "marks": now["marks"] | (marks or {})}, sort_keys=True).encode()))
            stream.close()
            if not fs.rename(draft, self._files("_manifests", f"{number:09d}.json")[1]):
                raise RuntimeError(f"publication {number} could not be made the current one")
        finally:
            fs.delete(claim, False)
        return number

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.read(name)
        raise AttributeError(name)


def seed(held: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Vocabulary rows after seeding: those held, as they are, and the offered ones whose key is new, once each.

    Seeding again changes nothing.
    """
    new = offered.join(held.select(key), key, "left_anti").dropDuplicates([key])
    return held.unionByName(new.select(*held.columns))
