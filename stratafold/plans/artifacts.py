"""Plans as tables and as JSON, execution artifacts, review of clusters, shortcuts for waste folders."""

from __future__ import annotations

import json
import re
import textwrap
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import chain, groupby, islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.sizes import fixed
from stratafold.operators import clusters as C
from stratafold.operators.snapshot import SnapshotStore
from stratafold.plans.proposals import STATES
from stratafold.scratch import materialize, shared_dir

#: The lines of a plan's JSON that name an entry or its state.
_NAMED = re.compile(r'\s+"(proposal_id|cluster_id|approval_state|status)": (".*")')
PROPOSALS = "proposal_id string, action string, source_paths array<string>, target_path string, reason string, approval_state string"
CLUSTERS = "cluster_id string, top int, min_score double, is_suppressed boolean, status string, turn int"
MEMBERS = "cluster_id string, path string, is_master boolean, file_count long, total_bytes long, unique_file_count long"
UNIQUE_FILES = "cluster_id string, copy string, path string, size long"


def _new(folder: str | Path, kind: str) -> tuple[str, Path, dict]:
    """The id, the path and the first entries of an artifact."""
    made = uuid.uuid4().hex
    Path(folder).mkdir(parents=True, exist_ok=True)
    return made, Path(folder) / f"{kind}-{made}.json", {f"{kind}_id": made, "created_at": datetime.now(UTC).isoformat()}


def _entries(out, name: str, entries: Iterable[Iterable[str]], last: bool) -> None:
    """A list of the artifact, an entry at a time; entries come in pieces of text."""
    out.write(f'  "{name}": [')
    n = 0
    for pieces in entries:
        out.write(",\n" if n else "\n")
        out.writelines(pieces)
        n += 1
    out.write(("\n  ]" if n else "]") + ("\n}\n" if last else ",\n"))


def _shifted(value, by: int) -> str:
    """Indented JSON, moved to the right."""
    return textwrap.indent(json.dumps(value, indent=2), " " * by)


def _stream(path: Path, head: dict, lists: dict[str, Iterable[Iterable[str]]]) -> Path:
    """Writes an artifact entry by entry, under another name until it is whole."""
    part = path.with_suffix(".part")
    with open(part, "w") as out:
        out.write(json.dumps(head, indent=2)[:-2] + ",\n")
        for i, (name, entries) in enumerate(lists.items(), 1):
            _entries(out, name, entries, i == len(lists))
    return part.rename(path)


def plan_tables(mastered: DataFrame, scores: DataFrame, hidden: DataFrame, unique: DataFrame) -> dict[str, DataFrame]:
    """The clusters of a plan as tables: clusters, members, and a row per unique file.

    ``turn`` counts the changes of a cluster's master; members and unique files of earlier
    turns no longer count. ``top`` is the depth of the shallowest member.
    """
    rows = unique.select("cluster_id", "copy", "path", "size")
    held = rows.groupBy("cluster_id", F.col("copy").alias("path")).agg(F.count("*").alias("unique_file_count"))
    members = mastered.join(held, ["cluster_id", "path"], "left").na.fill(0, ["unique_file_count"])
    per = mastered.groupBy("cluster_id").agg(F.min(F.size(F.split("path", "/"))).alias("top"))
    per = per.join(scores, "cluster_id").join(hidden.withColumn("is_suppressed", F.lit(True)), "cluster_id", "left").select(
        "cluster_id", "top", fixed(F.col("min_score"), 4).cast("double").alias("min_score"), F.coalesce("is_suppressed", F.lit(False)).alias("is_suppressed"), F.lit("pending").alias("status"), F.lit(0).alias("turn")
    )
    return {"clusters": per, "members": _of_turn(members, 0, "path"), "unique_files": _of_turn(rows, 0, "copy", "path")}


def _of_turn(rows: DataFrame, turn: int, *names: str) -> DataFrame:
    """The rows with their turn and a key of their own."""
    return rows.withColumn("turn", F.lit(turn)).withColumn("key", F.concat_ws("\0", "cluster_id", F.lit(str(turn)), *names))


class Plan:
    """A plan as tables in a folder; changes are deltas of the rows that change."""

    KEYS = {"proposals": "proposal_id", "clusters": "cluster_id", "members": "key", "unique_files": "key"}

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, str(folder)
        self.stores = {n: SnapshotStore(spark, f"{folder}/{n}", key) for n, key in self.KEYS.items()}

    @classmethod
    def of(cls, spark: SparkSession, path: str | Path) -> Plan:
        """The plan whose JSON or folder of tables is named; one that has only the JSON is read into tables."""
        if Path(path).is_dir():
            return cls(spark, path)
        head = header(path)
        if "tables" not in head:
            return cls._from_json(spark, load(path))
        plan = cls(spark, head["tables"])
        plan._take_over(path)
        return plan

    def _take_over(self, path: str | Path) -> None:
        """States that people changed in the JSON go into the tables; what is not pending there is all that is held."""
        decided: dict[str, list] = {"proposals": [], "clusters": []}
        with open(path) as f:
            for line in f:
                if found := _NAMED.match(line):
                    name, value = found.groups()
                    if name.endswith("_id"):
                        kind, own = ("clusters" if name == "cluster_id" else "proposals"), json.loads(value)
                    elif (state := json.loads(value)) != "pending":
                        if state not in STATES:
                            raise ValueError(f"no such status: {state}")
                        decided[kind].append((own, state))
        for kind, column in (("proposals", "approval_state"), ("clusters", "status")):
            rows, key = self.read(kind), self.KEYS[kind]
            new = self.spark.createDataFrame(decided[kind], f"{key} string, __new string")
            rows = rows.join(new, key, "left").withColumn("__new", F.coalesce("__new", F.lit("pending"))).filter(F.col("__new") != F.col(column))
            rows = materialize(rows.withColumn(column, F.col("__new")).drop("__new"), "decided")
            if not rows.isEmpty():
                self.stores[kind].upsert(rows)

    @classmethod
    def _from_json(cls, spark: SparkSession, plan: dict) -> Plan:
        self = cls(spark, f"{shared_dir(spark)}/stratafold/plan-{uuid.uuid4().hex}")
        proposals = [(p["proposal_id"], p["action"], p.get("source_paths", []), p.get("target_path"), p.get("reason"), p.get("approval_state", "pending")) for p in plan["proposals"]]
        clusters = [(c["cluster_id"], 0, c.get("min_score"), c.get("is_suppressed", False), c.get("status", "pending"), 0) for c in plan.get("clusters", [])]
        each = [(c["cluster_id"], m) for c in plan.get("clusters", []) for m in c["members"]]
        members = [(c, m["path"], m["is_master"], m.get("file_count", 0), m.get("total_bytes", 0), len(m["unique_files"])) for c, m in each]
        files = [(c, m["path"], f, None) for c, m in each for f in m["unique_files"]]
        self._write({
            "proposals": spark.createDataFrame(proposals, PROPOSALS), "clusters": spark.createDataFrame(clusters, CLUSTERS),
            "members": _of_turn(spark.createDataFrame(members, MEMBERS), 0, "path"), "unique_files": _of_turn(spark.createDataFrame(files, UNIQUE_FILES), 0, "copy", "path"),
        })
        return self

    def _write(self, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            self.stores[name].write(rows)

    def read(self, name: str) -> DataFrame:
        """A table; of members and unique files, those of the present turn."""
        rows = self.stores[name].read()
        if name in ("proposals", "clusters"):
            return rows
        return rows.join(self.stores["clusters"].read().select("cluster_id", "turn"), ["cluster_id", "turn"], "left_semi")

    def set_status(self, cluster_id: str, status: str) -> None:
        if status not in STATES:
            raise ValueError(f"no such status: {status}")
        self.stores["clusters"].upsert(self.read("clusters").filter(F.col("cluster_id") == cluster_id).withColumn("status", F.lit(status)))

    def cycle_master(self, cluster_id: str, files: DataFrame) -> None:
        """Makes the cluster's next member its master; ``files`` (folder, path, size, full_hash) give the unique files anew."""
        own = F.col("cluster_id") == cluster_id
        cluster = self.read("clusters").filter(own)
        turn = cluster.first()["turn"] + 1
        moved = materialize(C.next_master(self.read("members").filter(own).drop("unique_file_count", "turn", "key")), "moved")
        unique = materialize(C.unique_files(moved, files), "unique")
        tables = plan_tables(moved, cluster.select("cluster_id", "min_score"), cluster.filter("is_suppressed").select("cluster_id"), unique)
        self.stores["members"].upsert(_of_turn(tables["members"], turn, "path"))
        self.stores["unique_files"].upsert(_of_turn(tables["unique_files"], turn, "copy", "path"))
        self.stores["clusters"].upsert(materialize(cluster.withColumn("turn", F.lit(turn)), "cluster"))

    def status_counts(self) -> dict[str, int]:
        counts = {r["status"]: r["n"] for r in self.read("clusters").groupBy("status").agg(F.count("*").alias("n")).collect()}
        return {s: counts[s] for s in STATES if s in counts}

    def nested(self, hidden_too: bool = True, most_files: int | None = None) -> Iterator[tuple[dict, Iterator[tuple[dict, Iterator[str]]]]]:
        """Clusters, the shallowest first, each with its members, each with its unique files (the first ``most_files``), as one sorted stream."""
        files = self.read("unique_files").select("cluster_id", F.col("copy").alias("path"), F.col("path").alias("file"))
        if most_files is not None:
            place = F.row_number().over(W.partitionBy("cluster_id", "path").orderBy("file"))
            files = files.withColumn("place", place).filter(F.col("place") <= most_files).drop("place")
        shown = self.read("clusters") if hidden_too else self.read("clusters").filter("not is_suppressed")
        rows = shown.drop("turn").join(self.read("members").drop("turn", "key"), "cluster_id").join(files, ["cluster_id", "path"], "left")
        names = ("path", "is_master", "file_count", "total_bytes", "unique_file_count")

        def members(of):
            for _, same in groupby(of, key=lambda r: r["path"]):
                first = next(same)
                yield {n: first[n] for n in names}, (r["file"] for r in chain([first], same) if r["file"] is not None)

        for _, of in groupby(rows.orderBy("top", "cluster_id", "path", "file").toLocalIterator(), key=lambda r: r["cluster_id"]):
            first = next(of)
            yield {n: first[n] for n in ("cluster_id", "min_score", "is_suppressed", "status")}, members(chain([first], of))

    def _cluster_texts(self) -> Iterator[Iterator[str]]:
        for cluster, members in self.nested():
            yield chain([_shifted(cluster, 4)[:-6] + ',\n      "members": ['], self._member_texts(members), ["\n      ]\n    }"])

    @staticmethod
    def _member_texts(members) -> Iterator[str]:
        for i, (member, files) in enumerate(members):
            yield ("," if i else "") + "\n" + _shifted(member, 8)[:-10] + ',\n          "unique_files": ['
            n = -1
            for n, file in enumerate(files):
                yield ("," if n else "") + f"\n            {json.dumps(file)}"
            yield ("\n          ]" if n >= 0 else "]") + "\n        }"

    def export(self, path: Path, head: dict) -> Path:
        """The plan as JSON for people. Rows pass through the driver as a stream; it holds none of the lists."""
        proposals = ([_shifted({**{n: r[n] for n in ("proposal_id", "action", "source_paths", "target_path", "reason", "approval_state")}}, 4)] for r in self.read("proposals").orderBy("proposal_id").toLocalIterator())
        return _stream(path, head, {"proposals": proposals, "clusters": self._cluster_texts()})


def write_plan(folder: str | Path, proposals: DataFrame, tables: dict[str, DataFrame], run_id: int, similarity_run_id: int) -> Path:
    """plan-<id>.json, and beside it the folder plan-<id> with the same as tables."""
    _, path, head = _new(folder, "plan")
    head |= {"scan_run_id": run_id, "similarity_scan_run_id": similarity_run_id, "tables": str(path.with_suffix(""))}
    plan = Plan(proposals.sparkSession, head["tables"])
    plan._write({"proposals": proposals, **tables})
    return plan.export(path, head)


def write_execution(folder: str | Path, plan_id: str, results: Iterable[dict], rows: str | None = None) -> Path:
    """execution-<id>.json; ``rows``: where the table of all copied files lies."""
    _, path, head = _new(folder, "execution")
    return _stream(path, head | {"plan_id": plan_id} | ({"rows": rows} if rows else {}), {"proposal_results": ([_shifted(r, 4)] for r in results)})


def load(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def header(path: str | Path) -> dict:
    """The entries of an artifact before its lists."""
    lines: list[str] = []
    with open(path) as f:
        for line in f:
            if line.startswith(('  "proposals"', '  "proposal_results"')):
                return json.loads("".join(lines).rstrip().rstrip(",") + "}")
            lines.append(line)
    return json.loads("".join(lines))


def latest(folder: str | Path, kind: str) -> Path | None:
    """The artifact made last, by its created_at."""
    found = [(header(p)["created_at"], str(p)) for p in Path(folder).glob(f"{kind}-*.json")]
    return Path(max(found)[1]) if found else None


def is_current(plan: dict, run_id: int, similarity_run_id: int) -> bool:
    return int(plan.get("scan_run_id") or 0) >= run_id and int(plan.get("similarity_scan_run_id") or 0) >= similarity_run_id


def detail_text(cluster: dict, members: Iterable[tuple[dict, Iterable[str]]], most: int = 15) -> str:
    """A cluster as a reviewer reads it: a line of figures, a line per member with its role and bytes, below each copy the first files only it holds."""
    flags = [cluster["status"]] + ["inside a larger cluster"] * bool(cluster["is_suppressed"])
    text = [f"{cluster['cluster_id']} | weakest link {cluster['min_score']:.4f} | {', '.join(flags)}"]
    for member, files in members:
        role, own = ("keeps", "") if member["is_master"] else ("copy", f", {member['unique_file_count']:,} found nowhere else")
        text.append(f"  [{role}] {member['path']} ({member['file_count']:,} files, {short_size(member['total_bytes'])}{own})")
        text += [f"    + {f[len(member['path']) + 1:]}" for f in islice(files, most)]
        if member["unique_file_count"] > most:
            text.append(f"    + {member['unique_file_count'] - most:,} others")
    return "\n".join(text)


def short_size(n: int) -> str:
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n / 1024:.1f} KB"


def waste_text(candidates: list[dict]) -> str:
    """The waste folders as one list per review state, largest first, each headed by its total."""
    if not candidates:
        return "Nothing to clear."
    text = []
    for needs_review, title in ((False, "Can go"), (True, "Look first")):
        rows = sorted((c for c in candidates if c["requires_review"] == needs_review), key=lambda c: (-c["size_bytes"], c["path"]))
        if rows:
            text.append(f"{title}: {short_size(sum(c['size_bytes'] for c in rows))} in {len(rows):,} folders")
            text += [f"  {short_size(c['size_bytes'])}\t{c['file_count']:,} files\t{c['category']}\t{c['path']}" for c in rows]
    return "\n".join([*text, f"Together: {short_size(sum(c['size_bytes'] for c in candidates))}"])


def write_shortcuts(candidates: list[dict], folder: str | Path) -> int:
    """A ranked .url file per waste folder, largest first, named by size, review, category and the end of its path; earlier ones go."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob("*.url"):
        old.unlink()
    ranked = sorted(candidates, key=lambda c: (-c["size_bytes"], c["path"]))
    for rank, c in enumerate(ranked, 1):
        tail = " ".join(c["path"].split("/")[-3:])
        review = " (review)" if c["requires_review"] else ""
        name = re.sub(r'[\\/:*?"<>|]', "_", f"{rank:03d} {short_size(c['size_bytes'])}{review} {c['category']} {tail}")[:200]
        (folder / f"{name}.url").write_text(f"[InternetShortcut]\nURL=file:///{c['path'].lstrip('/')}\n")
    return len(ranked)
