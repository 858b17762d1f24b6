"""State of an engine beside its tables: status of projects, a lock, triggers, throttles, settings."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class Files:
    """Small files in a folder of any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, body: str) -> None:
        """Put a file in place in one rename."""
        draft = self.at(f".{name}-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        self.fs.delete(self.at(name), False)
        if not self.fs.rename(draft, self.at(name)):
            raise OSError(f"{name} could not be written")

    def create(self, name: str, body: str) -> bool:
        """Make a file that must not exist yet."""
        self.fs.mkdirs(self.at(""))
        try:
            out = self.fs.create(self.at(name), False)
        except Exception as e:  # py4j wraps what Hadoop throws
            if "AlreadyExists" in str(e) or self.fs.exists(self.at(name)):
                return False
            raise
        out.write(bytearray(body.encode()))
        out.close()
        return True

    def changed_at(self, name: str) -> float | None:
        """When a file was last written, in seconds, None if there is none."""
        return self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000 if self.fs.exists(self.at(name)) else None


OPTIONS = ("request_splitter", "request_custom_extensions", "request_ignore_patterns")


class StatusStore:
    """The status of every project: not_found, indexing, indexed or indexfailed.

    Options that a step omits are those of the step before; empty ones clear them. A run found ``indexing`` when the
    store is opened was interrupted and reads as failed. On a write, entries that only the file has are kept, unless
    they were removed here.
    """

    def __init__(self, files: Files, name: str = "status.json"):
        self.files, self.name, self.removed = files, name, set()
        self._saving = Throttle(2.0)
        self.entries: dict[str, dict] = {}
        for identity, info in self._stored().items():
            if info["status"] == "indexing":
                info = info | {"status": "indexfailed", "error_message": "the run was interrupted", "last_attempted_percentage": info.get("indexing_percentage")}
            self.entries[identity] = info

    def _stored(self) -> dict[str, dict]:
        return json.loads(self.files.read(self.name) or "{}")

    def _put(self, identity: str, info: dict, options: dict | None) -> None:
        kept = self.entries.get(identity, {}) if options is None else options
        info = info | {k: kept[k] for k in OPTIONS if kept.get(k)}
        self.entries[identity] = info | {"last_updated": datetime.now(UTC).isoformat()}
        self.removed.discard(identity)
        self.save()

    def save(self) -> None:
        extra = {k: v for k, v in self._stored().items() if k not in self.entries and k not in self.removed}
        self.files.write(self.name, json.dumps(extra | self.entries, sort_keys=True))

    def indexing(self, identity: str, path: str, percentage: float = 0, options: dict | None = None) -> None:
        self._put(identity, {"status": "indexing", "local_path": path, "indexing_percentage": percentage}, options)

    def progress(self, identity: str, done: int, total: int) -> float:
        """Note how far a run is: 10 when it begins to work, 100 at its end; written at most every two seconds."""
        percentage = round(10 + done / max(1, total) * 90)
        if self.status(identity) == "indexing":
            self.entries[identity]["indexing_percentage"] = percentage
            if self._saving.ready():
                self.save()
        return percentage

    def indexed(self, identity: str, path: str, files: int, chunks: int, outcome: str = "completed", options: dict | None = None) -> bool:
        """False, and nothing written, for a complete run of nothing."""
        if files == 0 and chunks == 0 and outcome == "completed":
            return False
        self._put(identity, {"status": "indexed", "local_path": path, "indexed_files": files, "total_chunks": chunks, "index_status": outcome}, options)
        return True

    def failed(self, identity: str, path: str, message: str, percentage: float | None = None, options: dict | None = None) -> None:
        self._put(identity, {"status": "indexfailed", "local_path": path, "error_message": message, "last_attempted_percentage": percentage}, options)

    def remove(self, identity: str) -> None:
        self.entries.pop(identity, None)
        self.removed.add(identity)
        self.save()

    def status(self, identity: str) -> str:
        return self.get(identity).get("status", "not_found")

    def get(self, identity: str) -> dict:
        return self.entries.get(identity) or {}

    def listed(self, status: str) -> list[str]:
        """Identities of a status here, and those the file has with it unless their status here is another one."""
        stored = [k for k, v in self._stored().items() if v["status"] == status and k not in self.removed]
        return sorted({k for k, v in self.entries.items() if v["status"] == status} | {k for k in stored if k not in self.entries or self.entries[k]["status"] == status})


class Lock:
    """A lock file in a shared folder; one older than ``stale`` seconds is taken over. Only its owner releases it."""

    def __init__(self, files: Files, name: str = "sync.lock", stale: float = 600):
        self.files, self.name, self.stale, self.token = files, name, stale, None

    def acquire(self, now: float | None = None) -> bool:
        token = uuid.uuid4().hex
        if not self.files.create(self.name, token):
            at = self.files.changed_at(self.name)
            if at is None or (now or time.time()) - at <= self.stale:
                return False
            aside = f"{self.name}.stale-{token}"
            if not self.files.fs.rename(self.files.at(self.name), self.files.at(aside)):
                return False  # another one took it over
            self.files.fs.delete(self.files.at(aside), True)
            if not self.files.create(self.name, token):
                return False
        self.token = token
        return True

    def release(self) -> bool:
        held = self.token is not None and self.files.read(self.name) == self.token
        if held:
            self.files.fs.delete(self.files.at(self.name), False)
        self.token = None
        return held

    def __enter__(self) -> Lock:
        if not self.acquire():
            raise RuntimeError("another process holds the lock")
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class TriggerFile:
    """Fires once a file was touched and then left alone for ``quiet`` seconds."""

    def __init__(self, files: Files, name: str = "trigger", quiet: float = 2.0):
        self.files, self.name, self.quiet = files, name, quiet
        self.seen = files.changed_at(name)

    def fired(self, now: float | None = None) -> bool:
        at = self.files.changed_at(self.name)
        if at is None or at == self.seen or (now or time.time()) - at < self.quiet:
            return False
        self.seen = at
        return True


class Throttle:
    """True at most once in ``every`` seconds."""

    def __init__(self, every: float):
        self.every, self.last = every, None

    def ready(self, now: float | None = None) -> bool:
        now = time.monotonic() if now is None else now
        if self.last is not None and now - self.last < self.every:
            return False
        self.last = now
        return True


class Aborted(RuntimeError):
    pass


class Abort:
    """A request to stop: checked between steps, and running jobs of the group are cancelled."""

    def __init__(self, spark: SparkSession, group: str | None = None):
        self.spark, self.group, self.asked = spark, group or uuid.uuid4().hex, False

    def ask(self) -> None:
        self.asked = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        if self.asked:
            raise Aborted("the run was stopped")


class Poller:
    """When the next sync is due: ``first`` seconds after the start, then every ``every`` seconds (1 at least), or when triggered."""

    def __init__(self, run: Callable[[], object], every: float = 300, first: float = 5, trigger: TriggerFile | None = None):
        self.run, self.every, self.trigger = run, max(1.0, every), trigger
        self.due, self.busy = time.monotonic() + first, False

    def tick(self, now: float | None = None) -> bool:
        """Runs if it is time and no run is on; tells whether it ran."""
        now = time.monotonic() if now is None else now
        touched = self.trigger is not None and self.trigger.fired()
        if self.busy or now < self.due and not touched:
            return False
        self.busy = True
        try:
            self.run()
        finally:
            self.busy, self.due = False, now + self.every
        return True


def setting(name: str, default: str | None = None, env_file: str | None = None) -> str | None:
    """A setting from the process environment, else from a file of NAME=value lines, else the default."""
    if os.environ.get(name):
        return os.environ[name]
    if env_file and os.path.isfile(env_file):
        with open(env_file, encoding="utf-8") as f:
            for line in f:
                key, sep, value = line.strip().partition("=")
                if sep and key == name and not line.startswith("#"):
                    return value.strip().strip("'\"")
    return default


def resolve_path(given: str, cwd: str | None = None) -> str:
    """An absolute path: ``.`` and ``workspace`` are the enclosing repository, ``~`` and ``home`` the home folder."""
    text, here = given.strip(), cwd or os.getcwd()
    if text in (".", "./") or text.lower() == "workspace":
        return workspace_root(here) or here
    if text in ("~", "home") or text.startswith("~/"):
        home = os.path.expanduser("~")
        return home if text in ("~", "home") else os.path.join(home, text[2:])
    return text if os.path.isabs(text) else os.path.abspath(os.path.join(here, text))


def workspace_root(start: str) -> str | None:
    """The nearest folder above with a repository, else with another mark of a workspace."""
    for marks in ((".git",), ("package.json", "pnpm-workspace.yaml", ".vscode")):
        at = os.path.abspath(start)
        while at != os.path.dirname(at):
            if any(os.path.exists(os.path.join(at, m)) for m in marks):
                return at
            at = os.path.dirname(at)
    return None
