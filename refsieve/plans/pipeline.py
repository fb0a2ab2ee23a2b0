"""Incremental pipeline: named stages, a manifest of what ran, skipping what is up to date, going on after errors."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import time
import traceback
import types
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.dedup import dedup
from ..sources.ris import read_ris, to_table, write_ris
from ..sources.tables import tracked_files


def fingerprint(*parts: str) -> str:
    """SHA-256 of texts, each closed off."""
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode() + b"\x00")
    return h.hexdigest()


def _codes(code: types.CodeType) -> set[str]:
    """Names that a function and the functions inside it refer to."""
    return set(code.co_names).union(*[_codes(c) for c in code.co_consts if isinstance(c, types.CodeType)])


def full_code(f: Callable, seen: set[int] | None = None) -> str:
    """Source of a function, the values it closes over or has as defaults, and all that of every function of this package (or of its own module) that it calls.

    Functions and classes are followed through globals, modules and closures; other values count by their ``repr``.
    """
    seen = set() if seen is None else seen
    f = inspect.unwrap(f)
    if isinstance(f, functools.partial):
        return full_code(f.func, seen) + repr((f.args, sorted(f.keywords.items())))
    if inspect.ismethod(f):
        return full_code(f.__func__, seen) + repr(vars(f.__self__) if hasattr(f.__self__, "__dict__") else f.__self__)
    if id(f) in seen:
        return ""
    seen.add(id(f))
    parts = [inspect.getsource(f)]
    if inspect.isclass(f):
        return parts[0] + "".join(full_code(m, seen) for _, m in sorted(vars(f).items()) if inspect.isfunction(m))
    own = (__name__.split(".")[0], f.__module__)
    values = dict(inspect.getclosurevars(f).nonlocals) | {f"default {k}": v for k, v in enumerate(f.__defaults__ or ())} | {f"default {k}": v for k, v in (f.__kwdefaults__ or {}).items()}
    names = _codes(f.__code__)
    values |= {n: f.__globals__[n] for n in names if n in f.__globals__}
    for module in [v for v in values.values() if inspect.ismodule(v)]:
        values |= {f"{module.__name__}.{n}": getattr(module, n) for n in names if module.__name__.split(".")[0] == own[0] and hasattr(module, n)}
    for name, v in sorted(values.items()):
        if inspect.isfunction(v) or inspect.isclass(v) or isinstance(v, functools.partial):
            if inspect.isfunction(v) and (v.__module__ == own[1] or v.__module__.split(".")[0] == own[0]) or inspect.isclass(v) and v.__module__.split(".")[0] == own[0]:
                parts.append(full_code(v, seen))
        elif isinstance(v, (str, bytes, int, float, bool, type(None), tuple, list, dict, set, frozenset)):
            parts.append(f"{name}={sorted(v, key=repr) if isinstance(v, (set, frozenset)) else v!r}")
    return "\x00".join(parts)


@dataclass
class Stage:
    """A named computation. ``run`` gets the results of ``deps`` by name and returns a DataFrame or a path."""

    name: str
    run: Callable
    deps: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    uses: list[Callable] = field(default_factory=list)
    priority: float = 0.5

    def code(self) -> str:
        """All code and values that the stage depends on: what ``full_code`` finds, and ``uses`` beside it."""
        seen: set[int] = set()
        return "\x00".join(full_code(f, seen) for f in [self.run, *self.uses])


class Pipeline:
    """Stages over a store: results are Parquet (or tracked paths), one manifest entry per stage."""

    def __init__(self, spark: SparkSession, store: str, stages: list[Stage], workers: int = 4) -> None:
        self.spark, self.store, self.workers = spark, store.rstrip("/"), workers
        self.stages = {s.name: s for s in stages}
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.ran: list[str] = []

    def order(self) -> list[list[str]]:
        """Waves of stages whose dependencies are in earlier waves; within a wave, higher priority first."""
        done: set[str] = set()
        waves = []
        while len(done) < len(self.stages):
            wave = [n for n, s in self.stages.items() if n not in done and set(s.deps) <= done]
            if not wave:
                raise ValueError("the stages form a cycle or name an unknown stage")
            waves.append(sorted(wave, key=lambda n: -self.stages[n].priority))
            done |= set(wave)
        return waves

    def manifest(self) -> dict[str, dict]:
        """Latest entry of each stage."""
        for name in ("_manifest", "_manifest_next"):  # the second where a run ended between removal and renaming
            if self._fs.exists(self._path(f"{self.store}/{name}/_SUCCESS")):
                return {r["name"]: r.asDict() for r in self.spark.read.json(f"{self.store}/{name}", schema=self._schema).collect()}  # one row per stage
        return {}

    _schema = (
        "name string, type string, data string, command string, depend string, seed bigint, path string, time double, size bigint, bytes bigint, format string, repository string, iteration string, parent string, children string, "
        "seconds double, warnings string, error string, state string"
    )

    def _record(self, entries: dict[str, dict]) -> None:
        """Write the manifest beside the old one, then take its place."""
        lines = [json.dumps(e) for e in entries.values()]
        new, old = self._path(f"{self.store}/_manifest_next"), self._path(f"{self.store}/_manifest")
        self.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{self.store}/_manifest_next")
        self._fs.delete(old, True)
        self._fs.rename(new, old)

    def _bytes(self, path: str) -> int | None:
        p = self._path(path)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else None

    def _files(self, stage: Stage) -> str:
        if not stage.files:
            return ""
        rows = [r for f in stage.files for r in tracked_files(self.spark, f).select("path", "sha256").collect()]  # hashes of tracked files
        return json.dumps(sorted((r["path"], r["sha256"]) for r in rows))

    def load(self, name: str) -> DataFrame | str:
        """The stored result of a stage."""
        path = self.manifest()[name]["path"]
        return self.spark.read.parquet(path) if path.startswith(f"{self.store}/objects/") else path

    def run(self) -> dict[str, str]:
        """Run what is outdated; the state of each stage: ran, skipped, failed or blocked."""
        old, entries, states = self.manifest(), {}, {}
        self.ran = []
        for wave in self.order():
            with ThreadPoolExecutor(self.workers) as pool:
                for name, state, entry in pool.map(lambda n: self._one(n, old, entries, states), wave):
                    states[name] = state
                    if entry:
                        entries[name] = entry
            self._record({**{n: e for n, e in old.items() if n in self.stages}, **entries})
        return states

    def _one(self, name: str, old: dict, entries: dict, states: dict) -> tuple[str, str, dict | None]:
        s = self.stages[name]
        if any(states[d] in ("failed", "blocked") for d in s.deps):
            return name, "blocked", None
        began = time.time()
        entry = {"name": name, "type": "stem", "command": "", "depend": "", "data": "", "path": "", "repository": "local", "children": " ".join(s.deps), "state": "done", "time": began, "error": ""}
        try:
            entry["command"] = fingerprint(s.code())
            entry["depend"] = fingerprint(self._files(s), *[entries[d]["data"] for d in s.deps])
            was = old.get(name)
            if was and was["state"] == "done" and (was["command"], was["depend"]) == (entry["command"], entry["depend"]) and self._fs.exists(self._path(was["path"])):
                return name, "skipped", was
            ready = {d: self.spark.read.parquet(entries[d]["path"]) if entries[d]["path"].startswith(f"{self.store}/objects/") else entries[d]["path"] for d in s.deps}
            out = s.run(**ready)
            if isinstance(out, DataFrame):
                entry["path"] = f"{self.store}/objects/{name}-{entry['command'][:8]}{entry['depend'][:8]}"
                out.write.mode("overwrite").parquet(entry["path"])
            else:
                entry["path"] = str(out)
            entry["format"] = "parquet" if isinstance(out, DataFrame) else "file"
            entry["bytes"] = self._bytes(entry["path"])
            entry["data"] = fingerprint(entry["command"], entry["depend"])
            self.ran.append(name)
            return name, "ran", {**entry, "seconds": time.time() - began}
        except Exception:
            return name, "failed", {**entry, "state": "failed", "seconds": time.time() - began, "error": traceback.format_exc()[-2000:]}

    def mermaid(self) -> str:
        """The stages as a Mermaid graph with their states."""
        was = self.manifest()
        lines = ["graph LR"]
        for n, s in self.stages.items():
            m = was.get(n)
            state = "outdated" if not m else "errored" if m["state"] == "failed" else "uptodate" if m["command"] == fingerprint(s.code()) else "outdated"
            lines.append(f'  {n}(["{n}"]):::{state}')
            lines += [f"  {d} --> {n}" for d in s.deps]
        lines += ["  classDef uptodate fill:#dcedc8,stroke:#33691e", "  classDef outdated fill:#fff3c4,stroke:#8d6e00", "  classDef errored fill:#f8d0d0,stroke:#8b0000"]
        return "\n".join(lines) + "\n"

    def document(self, title: str, text: str = "") -> str:
        """A Markdown document of the pipeline: title, text, graph, and a table of what ran."""
        was = self.manifest()
        rows = [f"| {n} | {was[n]['state']} | {was[n]['seconds'] or 0:.2f} | {was[n]['bytes'] or ''} | {was[n]['path']} |" if n in was else f"| {n} | not run | | | |" for n in self.stages]
        return "\n".join([f"# {title}", "", *([text, ""] if text else []), "```mermaid", self.mermaid().rstrip(), "```", "", "| stage | state | seconds | bytes | path |", "| --- | --- | --- | --- | --- |", *rows, ""])

    def render(self, path: str, title: str, text: str = "") -> str:
        """Write the document to a file of the store's file system and return its path."""
        out = self._fs.create(self._path(path), True)
        try:
            out.write(bytearray(self.document(title, text).encode()))
        finally:
            out.close()
        return path


def bibliography_pipeline(spark: SparkSession, store: str, ris: str, output: str, files: int | None = None) -> Pipeline:
    """Read RIS, report and remove duplicates, write the kept records back (``files=1``: to one file)."""
    return Pipeline(
        spark,
        store,
        [
            Stage("tbl", lambda: to_table(read_ris(spark, ris)), files=[ris]),
            Stage("tbl_dup", lambda tbl: dedup(tbl, get_dup=True), ["tbl"]),
            Stage("tbl_dedup", lambda tbl: dedup(tbl), ["tbl"]),
            Stage("dat_dedup", lambda tbl_dedup: write_ris(tbl_dedup, output, files=files), ["tbl_dedup"]),
        ],
    )
