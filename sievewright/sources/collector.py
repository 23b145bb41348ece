"""A resumable collector of paged listings, as a streaming data source.

A *walk* goes through one source's pages from a cursor on.  Where it is, and why it has stopped, is the stream's offset, a row
for each walk: cursor, pages visited, items, the streak of known ids, the reason, where to go on.  So a batch that runs again reads
the same pages, and a query that is started again from its checkpoint goes on where the last planned batch ended.

A walk ends at the listing's end (a page of fewer than ``page_size`` rows, or no next cursor), in a loop (a cursor again), after ``max_items`` new
rows or ``max_pages`` pages (it may be resumed there), or, at its head, once ``streak`` rows in a row are known at the end of
a page; a backlog walks on through known rows.  Pages are always finished, so resuming skips none.

The driver plans: it fetches at most ``pages_a_batch`` pages of each walk to follow cursors, and keeps none.  The executors fetch
the same pages, one task each, and emit the rows that are not known.

That is for a listing's head.  A backlog whose cursors are known at more places than its head (an archive's page numbers) is walked by
``backlog``: walks from all of these places at once, each up to where the next began, followed on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: A page: its rows ``(id, payload)`` and the next cursor.
Page = tuple[list[tuple[str, str]], str | None]
Fetch = Callable[[str, str], Page]
SCHEMA = "source string, walk string, cursor string, position int, id string, payload string"


@dataclass(frozen=True)
class Rules:
    # Rows of a page, pages and items of a walk, known rows in a row that end it.
    page_size: int = 20
    max_pages: int = 12
    max_items: int = 250
    streak: int = 8
    pages_a_batch: int = 4


@dataclass(frozen=True)
class Walk:
    source: str
    kind: str = "head"
    cursor: str = ""
    #: cursors of the pages that were walked
    visited: tuple[str, ...] = ()
    items: int = 0
    streak: int = 0
    stop: str = ""
    resume: str = ""

    @property
    def key(self) -> str:
        return f"{self.source}|{self.kind}"

    def offset(self) -> dict:
        return {"cursor": self.cursor, "visited": json.dumps(self.visited), "items": self.items, "streak": self.streak, "stop": self.stop, "resume": self.resume}

    @classmethod
    def at(cls, key: str, offset: dict) -> Walk:
        source, _, kind = key.rpartition("|")
        return cls(source, kind, **offset | {"visited": tuple(json.loads(offset["visited"]))})


def advanced(walk: Walk, ids: list[str], following: str | None, known: frozenset[str], rules: Rules) -> Walk:
    """The walk after a page of these ids."""
    items, streak = walk.items, walk.streak
    for one in ids:
        new = one not in known
        items, streak = items + new, 0 if new else streak + 1
    visited = (*walk.visited, walk.cursor)
    stop, resume = "", ""
    if walk.kind == "head" and streak >= rules.streak:
        stop = "seen_streak"
    elif following is None or len(ids) < rules.page_size:
        stop = "end"
    elif following in visited:
        stop = "loop"
    elif items >= rules.max_items:
        stop, resume = "max_items", following
    elif len(visited) >= rules.max_pages:
        stop, resume = "max_pages", following
    return replace(walk, cursor=following or "", visited=visited, items=items, streak=streak, stop=stop, resume=resume)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def known_ids(path: str, source: str, among: list[str]) -> frozenset[str]:
    """Which of these ids of a source are in a Parquet table ``(source, id)``, the memory of what was seen."""
    if not path or not among:
        return frozenset()
    files, where = _located(path)
    rows = ds.dataset(where, filesystem=files, format="parquet").to_table(columns=["id"], filter=(ds.field("source") == source) & ds.field("id").isin(among))
    return frozenset(rows["id"].to_pylist())


class PagePart(InputPartition):
    def __init__(self, source: str, kind: str, cursor: str) -> None:
        super().__init__((source, kind, cursor))


class WalkReader(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, rules: Rules, walks: list[Walk], known: str, state: str) -> None:
        self.fetch, self.rules, self.walks, self.known, self.state = fetch, rules, walks, known, state
        self.now: dict | None = None

    def initialOffset(self) -> dict:
        return {w.key: w.offset() for w in self.walks}

    def _planned(self) -> dict:
        """The offset that was planned last, by this reader or by one before it."""
        if self.now is None:
            files, where = _located(self.state)
            names = sorted((i.path for i in files.get_file_info(fs.FileSelector(where, allow_not_found=True)) if i.path.endswith(".json")), reverse=True)
            for name in names:
                with files.open_input_stream(name) as f:
                    try:
                        self.now = json.loads(f.read())
                        break
                    except ValueError:  # a writer that was lost; its batch is planned again
                        continue
        return self.now or self.initialOffset()

    def latestOffset(self) -> dict:
        out = {}
        for key, offset in self._planned().items():
            walk = Walk.at(key, offset)
            for _ in range(self.rules.pages_a_batch):
                if walk.stop:
                    break
                rows, following = self.fetch(walk.source, walk.cursor)
                ids = [i for i, _ in rows]
                walk = advanced(walk, ids, following, known_ids(self.known, walk.source, ids), self.rules)
            out[key] = walk.offset()
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.now = end
        files, where = _located(self.state)
        files.create_dir(where)
        pages = sum(len(json.loads(o["visited"])) for o in end.values())
        with files.open_output_stream(f"{where}/{pages:012d}.json") as f:
            f.write(json.dumps(end).encode())
        found = []
        for key, offset in end.items():
            walk = Walk.at(key, offset)
            before = len(json.loads(start[key]["visited"])) if key in start else 0
            found += [PagePart(walk.source, walk.kind, cursor) for cursor in walk.visited[before:]]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        source, kind, cursor = partition.value
        rows, _ = self.fetch(source, cursor)
        known = known_ids(self.known, source, [i for i, _ in rows])
        for position, (one, payload) in enumerate(rows):
            if one not in known:
                yield source, kind, cursor, position, one, payload


class Collected(DataSource):
    """The stream.  Subclasses set ``fetch``; options: ``walks`` (JSON of source, kind, cursor), ``known``, ``state``, and the rules by name.

    ``state`` is a folder beside the query's checkpoint, of its own.
    """

    fetch: Fetch

    @classmethod
    def name(cls) -> str:
        return "collected"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        given = {name: int(self.options[name]) for name in Rules.__dataclass_fields__ if name in self.options}
        walks = [Walk(source, kind, cursor) for source, kind, cursor in json.loads(self.options["walks"])]
        return WalkReader(type(self).fetch, Rules(**given), walks, self.options.get("known", ""), self.options["state"])


def collect(spark: SparkSession, fetch: Fetch, walks: list[tuple[str, str, str]], state: str, known: str = "", rules: Rules = Rules()) -> DataFrame:
    """The stream of the new rows of these walks (source, kind, cursor); plan and offsets as above."""
    spark.dataSource.register(type("Collecting", (Collected,), {"fetch": staticmethod(fetch)}))
    options = {name: str(getattr(rules, name)) for name in Rules.__dataclass_fields__}
    return spark.readStream.format("collected").options(walks=json.dumps(walks), known=known, state=state, **options).load()


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Batch by batch until every walk has stopped."""
    job = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()


def ended(state: str) -> list[Walk]:
    """Where the walks of a state folder stand: what to resume, and why they have stopped."""
    reader = WalkReader(lambda *_: ([], None), Rules(), [], "", state)
    return [Walk.at(key, offset) for key, offset in reader._planned().items()]


def resumed(walks: list[Walk]) -> list[tuple[str, str, str]]:
    """The walks to go on with: the backlog where one was cut short."""
    return [(w.source, "backlog", w.resume) for w in walks if w.resume]


WALKS = "source string, kind string, start string, until string"
_KEY = ("source", "kind", "start", "until")
_FETCHED = f"{WALKS}, number int, cursor string, following string, position int, id string, payload string"
_ENDS = f"{WALKS}, pages int, stop string, resume string"


def _followed(fetch: Fetch, rules: Rules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pages of walks, a frame each, to where a walk ends whatever is known; a page without rows is a row without an id."""
    names = [c.split()[0] for c in _FETCHED.split(", ")]

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, kind, start, until in frame[list(_KEY)].itertuples(index=False):
                cursor, visited = start, []
                while cursor is not None and cursor not in visited and len(visited) < rules.max_pages and (not visited or cursor != until):
                    rows, following = fetch(source, cursor)
                    places = [(source, kind, start, until, len(visited), cursor, following, i, *row) for i, row in enumerate(rows)]
                    yield pd.DataFrame(places or [(source, kind, start, until, len(visited), cursor, following, -1, None, None)], columns=names)
                    visited.append(cursor)
                    cursor = following if len(rows) >= rules.page_size else None

    return follow


def _ended(rules: Rules) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Where one walk ends, of its at most ``max_pages`` pages' ids and whether they are known."""

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        walk = Walk(first["source"], first["kind"], first["start"])
        for _, page in rows.sort_values(["number", "position"]).groupby("number"):
            ids, following = page["id"].dropna().tolist(), page["following"].iloc[0]
            walk = advanced(walk, ids, following, frozenset(page["id"][page["seen"]]), rules)
            if following is not None and following == first["until"] and walk.stop in ("", "max_items", "max_pages"):
                walk = replace(walk, stop="met", resume="")
            if walk.stop:
                break
        return pd.DataFrame([(first["source"], first["kind"], first["start"], first["until"], len(walk.visited), walk.stop, walk.resume)], columns=[*_KEY, "pages", "stop", "resume"])

    return end


def backlog(spark: SparkSession, fetch: Fetch, walks: DataFrame, known: DataFrame, folder: str, rules: Rules = Rules()) -> DataFrame:
    """The new rows of walks ``(source, kind, start, until)`` that are resumed until every one has stopped, in the columns of ``SCHEMA``.

    A walk also ends (``met``) before the cursor ``until``, where another begins; null is none.  Rounds are as many as the
    longest stretch between two starts has cuts.  ``folder`` keeps each round's pages and ends; a walk's starts must be distinct.
    """
    seen, found, run = known.select("source", "id").distinct().withColumn("seen", F.lit(True)), None, 0
    while not walks.isEmpty():
        # as many tasks as there are cores, four times over: a walk is a small row, but its pages take time
        fetched = walks.repartition(4 * spark.sparkContext.defaultParallelism, "source", "start").mapInPandas(_followed(fetch, rules), _FETCHED)
        fetched.join(seen, ["source", "id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False))).write.parquet(f"{folder}/pages-{run}")
        pages = spark.read.parquet(f"{folder}/pages-{run}")
        pages.drop("payload", "cursor").groupBy(*_KEY).applyInPandas(_ended(rules), _ENDS).write.parquet(f"{folder}/ends-{run}")
        ends = spark.read.parquet(f"{folder}/ends-{run}")
        kept = pages.join(ends.select("source", "kind", "start", "pages"), ["source", "kind", "start"]).filter("number < pages and not seen and id is not null")
        rows = kept.select("source", F.col("kind").alias("walk"), "cursor", "position", "id", "payload")
        found = rows if found is None else found.unionByName(rows)
        walks, run = ends.filter("resume <> ''").select("source", F.lit("backlog").alias("kind"), F.col("resume").alias("start"), "until"), run + 1
    return spark.createDataFrame([], SCHEMA) if found is None else found


def stored(folder: str) -> Fetch:
    """Pages from an archive: files of JSON lines ``{"id": ..., "payload": ...}`` in ``folder/source=.../page=...``, cursors the page numbers from 0."""

    def fetch(source: str, cursor: str) -> Page:
        files, where = _located(folder)
        number = int(cursor or 0)
        at = lambda n: [i.path for i in files.get_file_info(fs.FileSelector(f"{where}/source={source}/page={n}", allow_not_found=True)) if i.path.endswith(".json")]
        rows: list[tuple[str, str]] = []
        for path in at(number):
            with files.open_input_stream(path) as f:
                rows += [(r["id"], r["payload"]) for r in map(json.loads, f.read().decode().splitlines())]
        return rows, str(number + 1) if at(number + 1) else None

    return fetch
