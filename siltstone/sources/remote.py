"""Published artifacts: a store of blobs by key, a log of commits for each corpus, and the verbs that push to it and pull from it.

A commit names everything that it publishes (lines, digests, manifest), which is in place before it; its entry in the log is created under the next
number, and creation fails if another writer has taken that number. So a pointer moves from the state a writer has seen or not at
all: a writer that loses reads what is there now, asks again whether its push would lose records, and tries again. It reads its artifact back before it
tries, and its entry after it has won; an entry that a later one has passed over (it appeared while this one was still being written) counts as lost too.
File systems whose create() without overwriting is atomic (HDFS, stores with conditional puts) give exactly one winner. Lines are moved only by a push
that publishes them; whatever compares alone sorts their keys and digests.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import reports
from siltstone.session import written
from siltstone.sources import artifacts


class Remote(Protocol):
    """Blobs by key."""

    def has(self, key: str) -> bool: ...
    def get(self, key: str) -> bytes: ...
    def put(self, key: str, data: bytes) -> None: ...
    def put_many(self, entries: dict[str, bytes]) -> None: ...
    def list(self, prefix: str) -> list[str]: ...


class FolderRemote:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        if any(part in ("", ".", "..") for part in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        return f"{self.root}/{key}"

    def _at(self, key: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key) if key else self.root)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, key: str) -> bool:
        p, fs = self._at(key)
        return fs.exists(p)

    def get(self, key: str) -> bytes:
        p, fs = self._at(key)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        """Written aside and moved into place, so a reader sees the old or the new."""
        p, fs = self._at(key)
        aside, _ = self._at(key + ".part")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(aside, p):
            raise OSError(f"cannot write {key}")

    def create(self, key: str, data: bytes) -> bool:
        """Writes a key that isn't there; False if it is."""
        p, fs = self._at(key)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        return True

    def put_many(self, entries: dict[str, bytes]) -> None:
        for key, data in entries.items():
            self.put(key, data)

    def list(self, prefix: str) -> list[str]:
        p, fs = self._at(prefix.rstrip("/"))
        if not fs.exists(p):
            return []
        return sorted(f"{prefix.rstrip('/')}/{f.getPath().getName()}".lstrip("/") for f in fs.listStatus(p) if not f.getPath().getName().startswith("."))

    def remove(self, key: str) -> None:
        p, fs = self._at(key)
        fs.delete(p, True)


class Conflict(Exception):
    """Another writer has committed first, again and again."""


def init(remote: FolderRemote, corpus: str) -> bool:
    """Makes an empty corpus; False if there is one."""
    return remote.create(f"{corpus}/log/{0:012d}.json", json.dumps({"version": 0, "base": None, "address": None, "data": None}).encode())


def entries(remote: FolderRemote, corpus: str, waits: int = 20) -> list[dict]:
    """Commits in order, without those that later ones have passed over. One that can't be read yet is waited for, and then left out."""
    found = []
    for key in remote.list(f"{corpus}/log"):
        if not key.endswith(".json"):
            continue
        for nth in range(waits):
            try:
                found.append(json.loads(remote.get(key)))
                break
            except ValueError:
                time.sleep(0.05 if nth + 1 < waits else 0)
    chain, want = [], found[-1]["version"] if found else None
    for entry in reversed(found):
        if entry["version"] == want:
            chain.append(entry)
            want = entry["base"]
    return chain[::-1]


def head(remote: FolderRemote, corpus: str) -> dict | None:
    """The current commit, None where nothing is published."""
    chain = entries(remote, corpus)
    return chain[-1] if chain and chain[-1]["address"] else None


def versions(remote: FolderRemote, corpus: str) -> DataFrame:
    """version, address, lines, records, current of what has been published, the newest last."""
    rows = [(e["version"], e["address"], e["lines"], e["records"]) for e in entries(remote, corpus) if e["address"]]
    return remote.spark.createDataFrame([(*r, i == len(rows) - 1) for i, r in enumerate(rows)], "version long, address string, lines long, records long, current boolean")


def corpora(remote: FolderRemote) -> list[str]:
    return sorted(key for key in remote.list("") if remote.has(f"{key}/log"))


def push(remote: FolderRemote, corpus: str, chunks: DataFrame, force: bool = False, dry_run: bool = False, keep: int = 3, tries: int = 5) -> dict:
    """Publishes chunks (record_id besides the corpus columns). Returns what was done or would be. What is there already moves
    nothing; a push that would lose records is refused unless it is forced; chunks with an empty embedding are refused."""
    if "embedding" in chunks.columns and not chunks.where(F.coalesce(F.size("embedding"), F.lit(0)) <= 0).isEmpty():
        raise ValueError(f"{corpus}: chunks without an embedding can't be published")
    order, digests = artifacts.line_order(chunks), written(artifacts.record_sums(chunks))
    key, data = artifacts.order_address(order), None
    for attempt in range(1, tries + 1):
        chain = entries(remote, corpus)
        last = chain[-1] if chain else {"version": -1, "address": None}
        plan = {"added": digests.count(), "removed": 0, "changed": 0}
        if last["address"] == key:
            return {"address": key, "pushed": False, "reason": "unchanged", "tries": attempt}
        if last["address"]:
            held = remote.spark.read.parquet(remote.path(f"{last['data']}/digests"))
            plan = reports.push_guard(held, digests, force).first().asDict()
            if not plan["allowed"]:
                return plan | {"address": key, "pushed": False, "reason": "shrinks" if plan["shrinks"] else "unchanged", "tries": attempt}
        if dry_run:
            return plan | {"address": key, "pushed": False, "reason": "dry run", "tries": attempt}
        if data is None:
            data = f"{corpus}/data/{key}-{uuid.uuid4().hex[:8]}"
            artifacts.write_artifact(artifacts.artifact_lines(chunks, order=order), {"corpus": corpus}, remote.path(data), key, order.n)
            digests.write.parquet(remote.path(f"{data}/digests"))
            if not artifacts.check_artifact(remote.spark, remote.path(data))["sound"]:
                raise ValueError(f"{corpus}: what was written does not read back as {key}")
        number = max([int(k.rsplit("/", 1)[-1].split(".")[0]) for k in remote.list(f"{corpus}/log") if k.endswith(".json")], default=-1) + 1
        entry = {"version": number, "base": last["version"], "address": key, "data": data, "lines": order.n, "records": digests.count()}
        if number <= last["version"] or not remote.create(f"{corpus}/log/{number:012d}.json", json.dumps(entry, sort_keys=True).encode()):
            continue
        if entry not in entries(remote, corpus):
            continue
        retire(remote, corpus, keep)
        return plan | {"address": key, "pushed": True, "reason": "published", "tries": attempt, "version": number}
    raise Conflict(f"{corpus}: {tries} tries, each overtaken")


def retire(remote: FolderRemote, corpus: str, keep: int) -> list[str]:
    """Removes the data of commits older than the newest `keep`; what no commit names may be another writer's, and stays."""
    chain = [e for e in entries(remote, corpus) if e["address"]]
    used = {e["data"] for e in chain[-keep:]}
    gone = [e["data"] for e in chain[:-keep] if e["data"] not in used and remote.has(e["data"])]
    for data in gone:
        remote.remove(data)
    return gone


def _commit(remote: FolderRemote, corpus: str, version: int | None) -> dict:
    chain = [e for e in entries(remote, corpus) if e["address"] and version in (None, e["version"])]
    if not chain:
        raise FileNotFoundError(f"{corpus}: nothing is published" + (f" as version {version}" if version is not None else ""))
    return chain[-1]


def verify(remote: FolderRemote, corpus: str, version: int | None = None) -> dict:
    """What check_artifact finds in a version, the current one by default, and whether it is what its commit names."""
    entry = _commit(remote, corpus, version)
    found = artifacts.check_artifact(remote.spark, remote.path(entry["data"]))
    return found | {"version": entry["version"], "sound": found["sound"] and found["checksum"] == entry["address"] and found["lines"] == entry["lines"]}


def pull(remote: FolderRemote, corpus: str, schema: str, version: int | None = None) -> DataFrame:
    """The chunks of a version, the current one by default, after a check of its address."""
    entry = _commit(remote, corpus, version)
    if not verify(remote, corpus, entry["version"])["sound"]:
        raise ValueError(f"{corpus}: the artifact is not what its address {entry['address']} says")
    rows = artifacts.artifact_body(remote.spark, remote.path(entry["data"])).select("place", F.from_json("value", schema).alias("r")).select("r.*")
    return rows.withColumn("embedding", artifacts.decode_vector("embedding")) if dict(rows.dtypes).get("embedding") == "string" else rows


def status(remote: FolderRemote, corpus: str, chunks: DataFrame) -> str:
    """"absent", "current" or "behind"."""
    last = head(remote, corpus)
    if not last:
        return "absent"
    return "current" if last["address"] == artifacts.order_address(artifacts.line_order(chunks)) else "behind"
