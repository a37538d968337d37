"""Graphs on disk: Parquet tables in buckets by the hash of the id, upserts, versions, batches, backups.

Spark has no transactions, so each change writes a new folder and then a head, a small file under the next number that names the
folder of each bucket. The head with the largest number is the current one. A change of some rows writes the buckets that hold
them and no others. What is being written is never what is being read, and what was loaded before stays readable until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..sources.graphs import write_json
from .graph import Graph, canonical, not_among, one_of_each

TABLES = {"entities": schema.ENTITIES, "relations": schema.RELATIONS, "triples": schema.TRIPLES}


def parse_connection(text: str) -> dict[str, str]:
    """``k=v;k=v`` as a dict; keys are lower-cased, parts without ``=`` are left out."""
    parts = (p.partition("=") for p in text.split(";"))
    return {k.strip().lower(): v.strip() for k, eq, v in parts if eq}


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New rows win over old ones of the same key; of several new ones the one that sorts first by its columns in order."""
    fresh = one_of_each(new, key)
    return not_among(old, key, fresh, key).unionByName(fresh, allowMissingColumns=True)


def upsert_triples(old: DataFrame, new: DataFrame) -> DataFrame:
    """A triple that is there gets the new confidence only; its properties change if the new one has any. Of several new ones
    the one that sorts first counts."""
    fresh = one_of_each(new)
    n = fresh.select("id", F.col("confidence").alias("_c"), F.col("properties").alias("_p"))
    kept = old.join(n, "id", "left").withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("properties", F.when(F.coalesce(F.size("_p") > 0, F.lit(False)), F.col("_p")).otherwise(F.col("properties"))).drop("_c", "_p")
    return kept.unionByName(not_among(fresh, "id", old).select(*old.columns))


def bucket_of(buckets: int):
    """The bucket of a row by its id."""
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def cascade_delete(graph: Graph, ids: DataFrame) -> Graph:
    return graph.remove_entities(ids)


@dataclass
class Store:
    """Graphs below a path, in any file system that Spark reads and writes."""

    spark: SparkSession
    path: str
    #: Buckets of a table that is saved as a whole from now on; changes keep to the number that the graph has.
    buckets: int = 32
    _known: dict = field(default_factory=dict)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        """The file appears whole, under its name, or not at all."""
        fs, p = self._fs(path)
        _, part = self._fs(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, p):
            fs.delete(part, False)
            raise FileExistsError(path)

    def _get(self, path: str) -> str:
        fs, p = self._fs(path)
        into = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
        finally:
            into.close()

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # Graphs

    def graphs(self) -> list[str]:
        return self._list(f"{self.path}/graphs")

    def _heads(self, name: str) -> list[str]:
        return [x for x in self._list(f"{self.path}/graphs/{name}") if x.startswith("head-") and x.endswith(".json")]

    def save(self, graph: Graph, name: str | None = None) -> None:
        """All of a graph, isolated entities and unused relations too, in place of what has its name. What was there before can
        still be read by those who loaded it. Of two writers at once the later one gets an error where the file system refuses
        to rename over a file."""
        name = name or graph.name
        tables = {t: (getattr(graph, t), None) for t in TABLES}
        self._change(name, {"name": name, "description": graph.description, "buckets": self.buckets, "tables": {}}, tables)

    def _change(self, name: str, head: dict, tables: dict[str, tuple[DataFrame, list[int] | None]]) -> None:
        """A new head like ``head``, with some tables' buckets (all: None) replaced by rows, which are written first."""
        root, run, heads = f"{self.path}/graphs/{name}", uuid.uuid4().hex, self._heads(name)
        places = dict(head["tables"])
        try:
            for table, (rows, replaced) in tables.items():
                # a bucket goes to one task, or to several where it is large
                dealt = rows.withColumn("bucket", bucket_of(head["buckets"])).hint("rebalance", "bucket")
                dealt.write.partitionBy("bucket").parquet(f"{root}/{run}/{table}")
                kept = {} if replaced is None else {b: r for b, r in places[table].items() if int(b) not in replaced}
                places[table] = kept | {x[7:]: run for x in self._list(f"{root}/{run}/{table}") if x.startswith("bucket=")}
            number = int(heads[-1][5:-5]) + 1 if heads else 1
            self._put(f"{root}/head-{number:012d}.json", json.dumps(head | {"tables": places}))
        except BaseException:
            self._delete(f"{root}/{run}")
            raise

    def _head(self, name: str) -> dict:
        heads = self._heads(name)
        if not heads:
            raise KeyError(f"no graph {name}")
        return json.loads(self._get(f"{self.path}/graphs/{name}/{heads[-1]}"))

    def _table(self, name: str, head: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, or those of some buckets."""
        places = [(b, run) for b, run in head["tables"][table].items() if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*(f"{self.path}/graphs/{name}/{run}/{table}/bucket={b}" for b, run in places))

    def load(self, name: str) -> Graph:
        head = self._head(name)
        return Graph(*(self._table(name, head, t) for t in TABLES), name, head["description"])

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Delete all but the ``keep`` last states of a graph, and the buckets that none of these rests on; how many states went.
        Nobody may be reading them any more."""
        root, heads = f"{self.path}/graphs/{name}", self._heads(name)
        used = {(run, table, f"bucket={b}") for h in heads[-keep:] for table, places in json.loads(self._get(f"{root}/{h}"))["tables"].items() for b, run in places.items()}
        for h in heads[:-keep]:
            self._delete(f"{root}/{h}")
        for run in (x for x in self._list(root) if not x.startswith("head-")):
            if run not in {r for r, _, _ in used}:
                self._delete(f"{root}/{run}")
                continue
            for table in self._list(f"{root}/{run}"):
                for b in self._list(f"{root}/{run}/{table}"):
                    if b.startswith("bucket=") and (run, table, b) not in used:
                        self._delete(f"{root}/{run}/{table}/{b}")
        return len(heads[:-keep])

    def delete(self, name: str) -> bool:
        there = self._exists(f"{self.path}/graphs/{name}")
        self._delete(f"{self.path}/graphs/{name}")
        return there

    def save_rows(self, name: str, **rows: DataFrame) -> dict[str, int]:
        """Upsert of entities, relations or triples in one write; how many rows of each were given.

        The buckets of the given ids, whose numbers alone go to the driver, are read, merged and written; the files of all other
        buckets stay as they are and belong to the new state too.
        """
        head, changed = self._head(name), {}
        for table, given in rows.items():
            buckets = self._touched(given, head)
            merge = upsert_triples if table == "triples" else upsert
            changed[table] = merge(self._table(name, head, table, buckets), given), buckets
        self._change(name, head, changed)
        return {k: v.count() for k, v in rows.items()}

    @staticmethod
    def _touched(rows: DataFrame, head: dict) -> list[int]:
        return [r.b for r in rows.select(bucket_of(head["buckets"]).alias("b")).distinct().collect()]

    def delete_rows(self, name: str, **ids: DataFrame) -> None:
        """Remove entities, relations or triples by their ids, with the triples that would be left without an end; only buckets that lose rows are written."""
        head, changed = self._head(name), {}
        g = self.load(name)
        for kind, rows in ids.items():
            g = getattr(g, f"remove_{kind}")(rows)
            if kind != "triples":
                changed[kind] = self._touched(rows, head)
        lost = self._touched(not_among(self._table(name, head, "triples"), "id", g.triples), head)
        if lost:
            changed["triples"] = lost
        for kind, buckets in changed.items():
            part = Graph(*(self._table(name, head, t, buckets if t == kind else []) for t in TABLES), name)
            for deleted, rows in ids.items():
                part = getattr(part, f"remove_{deleted}")(rows)
            changed[kind] = getattr(part, kind), buckets
        self._change(name, head, changed)

    # Versions

    def create_version(self, name: str, description: str = "", author: str = "") -> str:
        """A copy of the current graph under the next number, with what changed since the last version."""
        g, root, before = self.load(name), f"{self.path}/versions/{name}", self.versions(name)
        number = max((v["number"] for v in before), default=0) + 1
        id_ = f"{name}_{number:06d}"
        base = self.load_version(name, before[-1]["id"]) if before else Graph.empty(self.spark)
        try:
            for table in TABLES:
                getattr(g, table).write.parquet(f"{root}/{id_}/{table}")
            diff(base, g).write.parquet(f"{root}/{id_}/changes")
            changes = self.spark.read.parquet(f"{root}/{id_}/changes")
            counted = {f"{r.kind}_{r.change}": r.n for r in changes.groupBy("kind", "change").agg(F.count("*").alias("n")).collect()}
            self._put(f"{root}/{id_}/version.json", json.dumps({"id": id_, "graph": name, "number": number, "description": description, "author": author, "created": time.time(), "changes": counted}))
        except BaseException:  # a version is there whole or not at all
            self._delete(f"{root}/{id_}")
            raise
        return id_

    def versions(self, name: str) -> list[dict]:
        root = f"{self.path}/versions/{name}"
        return [json.loads(self._get(f"{root}/{v}/version.json")) for v in self._list(root) if self._exists(f"{root}/{v}/version.json")]

    def version(self, name: str, id_: str) -> dict:
        return next(v for v in self.versions(name) if v["id"] == id_)

    def load_version(self, name: str, id_: str) -> Graph:
        root = f"{self.path}/versions/{name}/{id_}"
        return Graph(*(self.spark.read.schema(s).parquet(f"{root}/{t}") for t, s in TABLES.items()), name)

    def rollback(self, name: str, id_: str) -> None:
        self.save(self.load_version(name, id_), name)

    def compare(self, name: str, a: str, b: str) -> DataFrame:
        """kind, id, change: what changed from version a to version b."""
        return diff(self.load_version(name, a), self.load_version(name, b))

    def export_comparison(self, name: str, a: str, b: str, path: str) -> None:
        """The same as JSON lines, in files by kind and change."""
        self.compare(name, a, b).write.partitionBy("kind", "change").json(path)

    def export_version(self, name: str, id_: str, path: str) -> None:
        """A version's graph as JSON lines, with its head."""
        head = self.version(name, id_)
        write_json(self.load_version(name, id_), path)
        self._put(f"{path}/version.json", json.dumps(head))

    # Backups

    def backup(self, kind: str = "full", name: str = "", base: str | None = None) -> str:
        """A full copy of all graphs, or what differs from the backup ``base``. The counts of each graph go with it."""
        number = max((b["number"] for b in self.backups()), default=0) + 1
        id_ = f"{name or kind}_{number:06d}"
        counts = {}
        for graph in self.graphs():
            g = self.load(graph)
            counts[graph] = {r.kind: r.n for r in g.counts().collect()}
            for table in TABLES:
                rows = getattr(g, table)
                if kind == "incremental":
                    before = getattr(self._backed(base, graph), table)
                    key = F.xxhash64(*[canonical(rows, c) for c in rows.columns])
                    rows = rows.withColumn("_k", key).join(before.select("id", F.xxhash64(*[canonical(before, c) for c in before.columns]).alias("_k")), ["id", "_k"], "left_anti").drop("_k").withColumn("gone", F.lit(False))
                    gone = before.join(getattr(g, table).select("id"), "id", "left_anti").withColumn("gone", F.lit(True))
                    rows = rows.unionByName(gone)
                rows.write.parquet(f"{self.path}/backups/{id_}/{graph}/{table}")
        self._put(f"{self.path}/backups/{id_}/backup.json", json.dumps({"id": id_, "number": number, "kind": kind, "base": base, "created": time.time(), "counts": counts}))
        return id_

    def backups(self) -> list[dict]:
        root = f"{self.path}/backups"
        # a backup that is being written, or broke off, has no head yet
        found = [json.loads(self._get(f"{root}/{b}/backup.json")) for b in self._list(root) if self._exists(f"{root}/{b}/backup.json")]
        return sorted(found, key=lambda b: b["number"])

    def _backed(self, id_: str, graph: str) -> Graph:
        info = next(b for b in self.backups() if b["id"] == id_)
        at = f"{self.path}/backups/{id_}/{graph}"
        if info["kind"] == "full":
            if not self._exists(at):
                return Graph.empty(self.spark, graph)
            return Graph(*(self.spark.read.schema(s).parquet(f"{at}/{t}") for t, s in TABLES.items()), graph)
        base, tables = self._backed(info["base"], graph), []
        for t, s in TABLES.items():
            change = self.spark.read.schema(f"{s}, gone boolean").parquet(f"{at}/{t}")
            tables.append(getattr(base, t).join(change.select("id"), "id", "left_anti").unionByName(change.filter("not gone").drop("gone")))
        return Graph(*tables, graph)

    def restore(self, id_: str) -> list[str]:
        info = next(b for b in self.backups() if b["id"] == id_)
        for graph in info["counts"]:
            self.save(self._backed(id_, graph), graph)
        return sorted(info["counts"])

    def validate(self, id_: str) -> bool:
        """Whether the backup, with what it rests on, still holds as many rows as when it was made."""
        info = next(b for b in self.backups() if b["id"] == id_)
        return all({r.kind: r.n for r in self._backed(id_, g).counts().collect()} == n for g, n in info["counts"].items())

    def delete_backup(self, id_: str) -> bool:
        """Refused while another backup rests on it."""
        if any(b["base"] == id_ for b in self.backups()):
            return False
        self._delete(f"{self.path}/backups/{id_}")
        return True

    def cleanup(self, keep: int = 10, days: float | None = 30) -> list[str]:
        """Delete backups beyond the newest ``keep`` and those older than ``days``, but none that another rests on."""
        found, gone, now = self.backups(), [], time.time()
        for place, b in enumerate(reversed(found)):  # the newest first, so what rests on a backup goes before it
            old = days is not None and now - b.get("created", now) > days * 86_400
            if (place >= keep or old) and self.delete_backup(b["id"]):
                gone.append(b["id"])
        return gone


def diff(base: Graph, new: Graph) -> DataFrame:
    """kind, id, change (added, modified, deleted) by content: a full outer join on the id and a comparison of hashes."""
    out = None
    for kind, a, b in (("entity", base.entities, new.entities), ("relation", base.relations, new.relations), ("triple", base.triples, new.triples)):
        # nulls, too, must differ from values
        key = lambda df: F.sha2(F.to_json(F.struct(*[canonical(df, c).alias(c) for c in sorted(df.columns) if c != "id"])), 256)
        x, y = a.select("id", key(a).alias("x")), b.select("id", key(b).alias("y"))
        change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "deleted").when(F.col("x") != F.col("y"), "modified")
        one = x.join(y, "id", "full_outer").select(F.lit(kind).alias("kind"), "id", change.alias("change")).filter("change is not null")
        out = one if out is None else out.unionByName(one)
    return out


def retained(backups: DataFrame, keep: int = 10, days: int = 30, now=None) -> DataFrame:
    """Backups (backup_id, graph, created) with keep: the newest ``keep`` of each graph that are at most ``days`` old."""
    now = F.current_timestamp() if now is None else now
    order = Window.partitionBy("graph").orderBy(F.desc("created"), F.desc("backup_id"))
    return backups.withColumn("nth", F.row_number().over(order)).withColumn("keep", (F.col("nth") <= keep) & (F.col("created") >= now - F.expr(f"interval {days} days")))


class Batch:
    """Batched writes with a status of their own; one distributed write each, as a job group that can be cancelled."""

    def __init__(self, store: Store):
        self.store, self.operations = store, {}

    def run(self, kind: str, name: str, rows: DataFrame, errors: int = 100) -> str:
        """``kind`` is save_ or delete_ with entities, relations or triples. Rows without an id are errors and are left out; with
        more than ``errors`` of them nothing is written."""
        op = uuid.uuid4().hex
        self._begin(op, kind)
        self._run(op, kind, name, rows, errors)
        return op

    def start(self, kind: str, name: str, rows: DataFrame, errors: int = 100) -> str:
        """The same beside the caller, who can ask for its status, cancel it or wait."""
        op = uuid.uuid4().hex
        self._begin(op, kind)

        def work():
            try:
                self._run(op, kind, name, rows, errors)
            except Exception:  # its status says so
                pass

        thread = InheritableThread(target=work, session=self.store.spark)
        self.operations[op]["thread"] = thread
        thread.start()
        return op

    def wait(self, op: str) -> dict:
        self.operations[op]["thread"].join()
        return self.status(op)

    def export(self, name: str, path: str) -> None:
        """A graph as JSON lines."""
        write_json(self.store.load(name), path)

    def _begin(self, op: str, kind: str) -> None:
        self.operations[op] = {"id": op, "kind": kind, "state": "running", "total": 0, "done": 0, "errors": 0, "error": ""}

    def _run(self, op: str, kind: str, name: str, rows: DataFrame, errors: int) -> None:
        action, table = kind.split("_")
        status, context = self.operations[op], self.store.spark.sparkContext
        context.setJobGroup(op, f"{kind} {name}", True)
        try:
            named = F.coalesce(F.col("id") != "", F.lit(False))
            n = rows.agg(F.count("*").alias("all"), F.count_if(~named).alias("bad")).first()
            status.update(total=n["all"], errors=n.bad)
            if n.bad > errors:
                raise ValueError(f"{n.bad} rows have no id")
            if status["state"] == "cancelled":
                raise RuntimeError("cancelled")
            (self.store.save_rows if action == "save" else self.store.delete_rows)(name, **{table: rows.filter(named)})
            status.update(state="done", done=n["all"] - n.bad)
        except Exception as e:
            if status["state"] != "cancelled":
                status.update(state="failed", error=str(e)[:100])
            raise
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def status(self, op: str) -> dict:
        s = {k: v for k, v in self.operations[op].items() if k != "thread"}
        return s | {"percent": 100.0 if not s["total"] else 100.0 * s["done"] / s["total"]}

    def cancel(self, op: str) -> bool:
        if self.operations.get(op, {}).get("state") != "running":
            return False
        self.operations[op]["state"] = "cancelled"
        # jobs of the operation that have not begun yet must not run either
        self.store.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(op)
        return True

    def cleanup(self) -> int:
        done = [k for k, v in self.operations.items() if v["state"] != "running"]
        for k in done:
            del self.operations[k]
        return len(done)


class Stores:
    """Stores by name, as factories of (spark, connection)."""

    def __init__(self):
        self._kinds = {"parquet": lambda spark, connection: Store(spark, parse_connection(connection)["path"])}
        self._open: dict[str, Store] = {}

    def register(self, kind: str, factory) -> None:
        self._kinds[kind] = factory

    def kinds(self) -> list[str]:
        return sorted(self._kinds)

    def open(self, name: str, kind: str, spark: SparkSession, connection: str) -> Store:
        self._open[name] = self._kinds[kind](spark, connection)
        return self._open[name]

    def get(self, name: str = "default") -> Store:
        return self._open[name]

    def close(self, name: str) -> None:
        self._open.pop(name, None)
