"""The workspace: files of a folder with their models, reads, search, dependencies, staged edits, versions and snapshots.

State is append-only Parquet below a store folder; what holds is the last row of its key. One call changes one file;
tables over many files are DataFrames (``model``, ``status``, ``search``). Models are kept by the hash of their source, so
a file that did not change is not parsed again, and all files that did are parsed in one distributed pass.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as data_field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import a1
from quirelake.functions import text as tx
from quirelake.operators import dependencies, edits, grid, search, status, versions
from quirelake.sources import files, packages
from quirelake.sources.writers import NotWritable, replace_file, write_back

STORE = {
    "objects": "object_path string, format_id string, size bigint, modified_ns bigint, source_hash string, seen_ms bigint",
    "models": files.SCAN,
    "views": "object_path string, source_hash string, request_hash string, content string, estimated_tokens int, truncated boolean, cursor int",
    "access_log": "operation string, object_path string, timestamp_unix_ms bigint, source_hash string, model_cache_hit boolean, view_cache_hit boolean, estimated_tokens int, truncated boolean",
    "staged": "tx_id string, object_path string, kind string, payload string, actor string, staged_at_ms bigint, expected_hash string, state string",
    "history": "object_path string, version bigint, tx_id string, kind string, actor string, applied_at_ms bigint, before_hash string, after_hash string, revert_of bigint, diff string, impact string",
    "manifests": "object_path string, package_hash string, pos int, name string, slice string, part_hash string, size bigint",
    "parts": "part_hash string, part binary",
}


class WorkspaceError(Exception):
    """An error with a stable code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class ReadResponse:
    content: str
    estimated_tokens: int
    truncated: bool
    cursor: int | None
    next_actions: list[str] = data_field(default_factory=list)


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def budgeted(content: str, max_tokens: int, cursor: int | None) -> ReadResponse:
    """The slice of a text that a budget allows, from a cursor in bytes on."""
    data = content.encode()
    start = cursor or 0
    try:
        rest = data[start:].decode() if 0 <= start <= len(data) else None
    except UnicodeDecodeError:
        rest = None
    if rest is None:
        raise WorkspaceError("invalid_cursor", f"{start} is no place to go on from")
    a, b = tx.paginate(rest, max_tokens)[0]
    part = rest[a:b]
    more = b < len(rest)
    return ReadResponse(part, -(-len(part) // tx.CHARS_PER_TOKEN), more, start + len(part.encode()) if more else None, ["read on from the cursor"] if more else [])


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, store: str | None = None) -> None:
        self.spark, self.folder = spark, os.path.abspath(folder)
        self.store = store or os.path.join(self.folder, ".quire")

    # ---- store

    def init(self) -> None:
        os.makedirs(self.store, exist_ok=True)
        path = os.path.join(self.store, "manifest.json")
        if not os.path.exists(path):
            replace_file(path, json.dumps({"schema": 1}).encode())

    def _open(self) -> None:
        path = os.path.join(self.store, "manifest.json")
        if not os.path.exists(path):
            raise WorkspaceError("workspace_not_initialized", self.folder)
        with open(path) as file:
            try:
                schema = json.load(file)["schema"]
            except (ValueError, KeyError, TypeError) as error:
                raise WorkspaceError("invalid_manifest", str(error)) from error
        if schema != 1:
            raise WorkspaceError("unsupported_manifest_schema", str(schema))

    def table(self, name: str) -> DataFrame:
        self._open()
        path = os.path.join(self.store, name)
        reader = self.spark.read.schema(STORE[name])
        return reader.parquet(path) if os.path.isdir(path) else self.spark.createDataFrame([], STORE[name])

    def _append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, STORE[name])
        df.write.mode("append").parquet(os.path.join(self.store, name))

    def _path(self, path: str) -> str:
        full = os.path.realpath(os.path.join(self.folder, path))
        if os.path.isabs(path) or not full.startswith(os.path.realpath(self.folder) + os.sep) or full.startswith(os.path.realpath(self.store)) or not os.path.isfile(full):
            raise WorkspaceError("invalid_source_path", path)
        return full

    def _log(self, operation: str, path: str, digest: str | None = None, model_hit: bool | None = None, view_hit: bool | None = None, response: ReadResponse | None = None) -> None:
        self._append("access_log", [(operation, path, now_ms(), digest, model_hit, view_hit, response.estimated_tokens if response else None, response.truncated if response else None)])

    @contextlib.contextmanager
    def _lock(self, path: str) -> Iterator[None]:
        """One writer of an object at a time; another one does not wait."""
        name = hashlib.sha256(path.encode()).hexdigest()[:24]
        with open(os.path.join(self.store, f"{name}.lock"), "w") as file:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as error:
                raise WorkspaceError("lock_busy", path) from error
            yield

    # ---- models

    def objects(self) -> DataFrame:
        """The last known state of each object."""
        return versions.last_writes(self.table("objects"), ["object_path"], ["seen_ms"], ["format_id", "size", "modified_ns", "source_hash"])

    def _listing(self, glob: str | None = None) -> DataFrame:
        found = files.list_files(self.spark, self.folder).where(~F.col("object_path").startswith(".quire/") & ~F.col("object_path").contains("/."))
        return found.where(tx.matches_glob(F.col("object_path"), glob)) if glob else found

    def refresh(self, glob: str | None = None) -> int:
        """Parse what is new or changed; the number of files parsed. Files whose hash is known only get their new time."""
        known = self.objects()
        seen = self._listing(glob).join(known.select("object_path", F.col("size").alias("k_size"), F.col("modified_ns").alias("k_ns"), F.col("source_hash").alias("k_hash")), "object_path", "left")
        stale = files.with_format(seen.where("k_size is null or k_size <> size or k_ns <> modified_ns")).withColumn("seen_ms", F.lit(now_ms())).cache()
        cached = self.table("models").select("object_path", "source_hash").distinct()
        todo = stale.join(cached, ["object_path", "source_hash"], "left_anti").cache()
        count = todo.count()
        if count:
            self._append("models", files.scan(todo))
        self._append("objects", stale.select(*[c.split()[0] for c in STORE["objects"].split(", ")]))
        stale.unpersist()
        todo.unpersist()
        return count

    def model(self, entity: str) -> DataFrame:
        """One entity over all objects, as they were last parsed."""
        head = self.objects().select("object_path", "source_hash")
        return files.entity(self.table("models").join(head, ["object_path", "source_hash"], "left_semi"), entity)

    def _object(self, path: str):
        self._path(path)
        before = self.objects().where(F.col("object_path") == path).first()
        self.refresh(glob=path)
        row = self.objects().where(F.col("object_path") == path).first()
        if row is None:
            raise WorkspaceError("unsupported_format", path)
        return row, before is not None and before.source_hash == row.source_hash

    def _entities(self, path: str, fmt: str, digest: str) -> edits.Tables:
        rows = self.table("models").where((F.col("object_path") == path) & (F.col("source_hash") == digest)).dropDuplicates(["entity", "entity_no"])
        wanted = {"xlsx": ("sheets", "cells", "named_ranges", "annotations", "features"), "docx": ("paragraphs", "story_paragraphs", "annotations"), "pptx": ("slides", "shapes", "slide_table_cells", "annotations"), "pdf": ("pages", "fields", "pdf_documents", "annotations")}[fmt]
        return {name: files.entity(rows, name).cache() for name in wanted}

    # ---- questions

    def status(self) -> DataFrame:
        """(path, state) of all tracked objects: missing, fresh_fast_path, fresh_after_hash, stale.

        Files are listed; only those whose size or time differ from what is known are opened.
        """
        known = self.objects().withColumnRenamed("object_path", "path")
        seen = self._listing().select(F.col("object_path").alias("path"), "size", "modified_ns")
        touched = seen.join(known.select("path", F.col("size").alias("k_size"), F.col("modified_ns").alias("k_ns")), "path").where("size <> k_size or modified_ns <> k_ns")
        listing = seen.join(files.hashes(touched, self.folder), "path", "left")
        return status.freshness(known, listing).select("path", "format_id", "state")

    def inspect(self, path: str) -> dict:
        """What a file holds, in numbers, with reads that suggest themselves."""
        row, hit = self._object(path)
        t = self._entities(path, row.format_id, row.source_hash)
        out: dict = {"format": row.format_id, "source_hash": row.source_hash}
        if row.format_id == "xlsx":
            counts = {r.sheet: r for r in grid.sheet_summary(t["cells"]).collect()}
            heads = {r.sheet: r for r in grid.header_rows(t["cells"]).collect()}
            out["sheets"] = [{"name": s.name, "rows": s.rows, "cols": s.cols, "merges": s.merges, "formula_count": counts[s.name].formula_count if s.name in counts else 0, "header_row": heads[s.name].header_row if s.name in heads and heads[s.name].is_header else None} for s in t["sheets"].orderBy("idx").collect()]
            out["named_ranges"] = [r.name for r in t["named_ranges"].orderBy("name").collect()]
            out["suggested_reads"] = [{"kind": "sheet", "value": s["name"]} for s in out["sheets"]]
        elif row.format_id == "docx":
            heading = F.coalesce(tx.fold(F.col("style_id")).startswith("heading"), F.lit(False)) | F.col("outline_level").isNotNull()
            out["paragraphs"] = t["paragraphs"].count()
            out["headings"] = [(r.idx, r.text) for r in t["paragraphs"].where(heading).orderBy("idx").collect()]
        elif row.format_id == "pptx":
            shapes = {r.slide: r for r in t["shapes"].groupBy("slide").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "ord").alias("preview")).collect()}
            out["slides"] = [{"name": s.name, "shapes": shapes[s.name].n if s.name in shapes else 0, "preview": shapes[s.name].preview if s.name in shapes else None, "notes": s.notes is not None} for s in t["slides"].orderBy("idx").collect()]
        else:
            out |= t["pdf_documents"].first().asDict()
            out["pages"] = t["pages"].count()
            out["fields"] = [{"name": f.name, "type": f.field_type, "value": f.value} for f in t["fields"].orderBy("name").collect()]
        out["annotations"] = t["annotations"].count()
        self._log("inspect", path, row.source_hash, hit)
        return out

    def read(self, path: str, kind: str | None = None, value: str | None = None, max_tokens: int = 2000, cursor: int | None = None) -> ReadResponse:
        """A projection of a file as text under a token budget; answers are kept by request and source."""
        row, hit = self._object(path)
        request = hashlib.sha256(json.dumps([path, kind, value, max_tokens, cursor]).encode()).hexdigest()
        kept = self.table("views").where((F.col("request_hash") == request) & (F.col("source_hash") == row.source_hash)).first()
        if kept:
            response = ReadResponse(kept.content, kept.estimated_tokens, kept.truncated, kept.cursor, ["read on from the cursor"] if kept.truncated else [])
        else:
            response = budgeted(self._render(path, row, kind, value), max_tokens, cursor)
            self._append("views", [(path, row.source_hash, request, response.content, response.estimated_tokens, response.truncated, response.cursor)])
        self._log("read", path, row.source_hash, hit, kept is not None, response)
        return response

    def _render(self, path: str, row, kind: str | None, value: str | None) -> str:
        t = self._entities(path, row.format_id, row.source_hash)
        lines = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
        unsupported = WorkspaceError("unsupported_capability", f"no selector {kind} for {row.format_id}")
        if row.format_id == "xlsx":
            cells = t["cells"]
            if kind in ("range", "ast_range"):
                r = self.spark.range(1).select(*[v.alias(k) for k, v in a1.rectangle(F.lit(value)).items()], a1.sheet_of(F.lit(value)).alias("s")).first()
                if r.r1 is None or r.s is None:
                    raise WorkspaceError("format_error", f"no range {value}")
                cells = grid.select_range(cells, r.s, r.r1, r.c1, r.r2, r.c2)
                if kind == "ast_range":
                    return "\n".join(x for _, x in lines(grid.range_json(cells), "sheet", "cells"))
            elif kind == "sheet":
                if t["sheets"].where(F.upper("name") == value.upper()).isEmpty():
                    raise WorkspaceError("format_error", f"no sheet {value}")
                cells = cells.where(F.upper("sheet") == value.upper())
            elif kind == "named_ranges":
                return "\n".join(f"{n} = {f}" for n, f in lines(t["named_ranges"].orderBy("name"), "name", "formula"))
            elif kind == "merges":
                return "\n".join(f"{n}: {', '.join(m or [])}" for n, m in lines(t["sheets"].orderBy("idx"), "name", "merges"))
            elif kind is None:
                cells = grid.preview(cells, t["sheets"].select("object_path", F.col("name").alias("sheet"), "idx")).drop("cell_no")
            elif kind != "full":
                raise unsupported
            order = {n: i for n, i in lines(t["sheets"], "name", "idx")}
            shown = lines(grid.render_markdown(grid.cap_cells(cells).drop("cell_no", "cut")), "sheet", "content")
            return "\n\n".join(f"## {n}\n{c}" for n, c in sorted(shown, key=lambda x: order.get(x[0], 0)))
        if row.format_id == "docx":
            if kind in (None, "full", "paragraphs"):
                rows = [x for (x,) in lines(t["paragraphs"].orderBy("idx"), "text")]
                return "\n".join(self._slice(rows, value) if kind == "paragraphs" else rows)
            if kind in ("headers", "footers"):
                part, _, place = (value or "").partition(":")
                rows = t["story_paragraphs"].where((F.col("story") == kind[:-1]) & (F.lit(not part) | (F.col("part") == part))).orderBy("part", "idx")
                texts = [x for (x,) in lines(rows, "text")]
                return "\n".join(self._slice(texts, place) if place else texts)
            raise unsupported
        if row.format_id == "pptx":
            slides = lines(t["slides"].orderBy("idx"), "name", "idx", "part_name", "notes")
            if kind in ("slide", "notes"):
                low = (value or "").lower()
                slides = [s for s in slides if low in (s[0].lower(), s[2].lower(), f"slide{s[1] + 1}", str(s[1] + 1))][:1]
                if not slides:
                    raise WorkspaceError("format_error", f"no slide {value}")
            elif kind not in (None, "full"):
                raise unsupported
            if kind == "notes":
                return slides[0][3] or ""
            shapes = lines(t["shapes"].orderBy("slide", "ord"), "slide", "name", "text")
            tables = lines(t["slide_table_cells"].orderBy("slide", "table_name", "row", "col"), "slide", "table_name", "row", "text")
            out = []
            for name, *_ in slides:
                out.append(f"## {name}")
                out += [f"{n}: {x}" for s, n, x in shapes if s == name]
                by_row: dict[tuple, list[str]] = {}
                for s, n, r, x in tables:
                    if s == name:
                        by_row.setdefault((n, r), []).append(x)
                out += ["| " + " | ".join(v) + " |" for v in by_row.values()]
            return "\n".join(out)
        if kind in (None, "full", "page"):
            rows = t["pages"].where(F.lit(kind != "page") | (F.col("number").cast("string") == (value or ""))).orderBy("number")
            pages = lines(rows, "number", "text")
            if kind == "page" and not pages:
                raise WorkspaceError("format_error", f"no page {value}")
            return "\n\n".join(f"## Page {n}\n{x}" for n, x in pages) if kind != "page" else pages[0][1]
        if kind == "field":
            found = t["fields"].where((F.col("name") == value) | (F.col("element_id") == value)).first()
            if found is None:
                raise WorkspaceError("format_error", f"no field {value}")
            return json.dumps(found.asDict(), ensure_ascii=False)
        raise unsupported

    @staticmethod
    def _slice(rows: list[str], value: str | None) -> list[str]:
        """``start:end``, half open, or one index; the end is clamped, a start beyond the rows is an error."""
        try:
            a, colon, b = (value or "").partition(":")
            start, end = int(a), int(b) if colon else int(a) + 1
        except ValueError as error:
            raise WorkspaceError("format_error", f"no slice {value}") from error
        if start < 0 or start >= len(rows) or end < start:
            raise WorkspaceError("format_error", f"{value} is outside of 0:{len(rows)}")
        return rows[start : min(end, len(rows))]

    def search(self, query: str, glob: str | None = None) -> DataFrame:
        """Hits in models, then in answers that were given, capped per file; only fresh objects are searched."""
        needle = query.strip()
        if not needle:
            raise WorkspaceError("format_error", "an empty query")
        fresh = self.status().where("state in ('fresh_fast_path', 'fresh_after_hash')").select(F.col("path").alias("object_path"))
        if glob:
            fresh = fresh.where(tx.matches_glob(F.col("object_path"), glob))
        head = self.objects().join(fresh, "object_path", "left_semi").select("object_path", "source_hash")
        rows = self.table("models").join(head, ["object_path", "source_hash"], "left_semi").withColumn("payload", F.concat(F.lit('{"'), "entity", F.lit('": ['), "fields", F.lit("]}")))
        views = self.table("views").join(head, ["object_path", "source_hash"], "left_semi")
        found = search.search_workspace(rows, "object_path", "payload", views, "object_path", "content", "request_hash", needle)
        self._log("search", glob or "**")
        return found

    def deps(self, path: str, sheet: str, address: str, direction: str = "forward") -> DataFrame:
        """What a cell uses, or what uses it. The cell must be there."""
        row, hit = self._object(path)
        if row.format_id != "xlsx":
            raise WorkspaceError("unsupported_capability", "only spreadsheets have dependencies")
        t = self._entities(path, row.format_id, row.source_hash)
        cell = t["cells"].where((F.upper("sheet") == sheet.upper()) & (F.col("address") == address.upper().replace("$", "")))
        if cell.isEmpty():
            raise WorkspaceError("format_error", f"no cell {sheet}!{address}")
        edges = dependencies.formula_edges(t["cells"], t["named_ranges"])
        self._log("deps", path, row.source_hash, hit)
        if direction == "forward":
            return dependencies.forward(edges, cell)
        users = dependencies.reverse(edges, cell).select("object_path", F.col("from_id").alias("element_id"))
        return t["cells"].join(users, ["object_path", "element_id"], "left_semi")

    def capabilities(self, fmt: str | None = None) -> DataFrame:
        rows = self.spark.createDataFrame(edits.capabilities(), "format_id string, operation string, payload string, entity string")
        return rows.where(F.col("format_id") == fmt) if fmt else rows

    def metrics(self) -> dict:
        history = self.table("history").groupBy("object_path").agg(F.max("version").alias("version_count"))
        objects = self.objects().join(history, "object_path", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0)))
        parts = self.table("parts").select("part_hash", F.octet_length("part").cast("bigint").alias("bytes"))
        return status.workspace_metrics(objects, parts, self.table("access_log")).first().asDict()

    # ---- edits

    def _staged_rows(self) -> DataFrame:
        """Edits that wait: the last state of each transaction."""
        columns = ["object_path", "kind", "payload", "actor", "expected_hash", "state"]
        first = self.table("staged").groupBy("tx_id").agg(F.min("staged_at_ms").alias("first_ms"))
        last = versions.last_writes(self.table("staged"), ["tx_id"], ["staged_at_ms", "state"], columns)
        return last.join(first, "tx_id").withColumnRenamed("first_ms", "staged_at_ms")

    def staged(self, path: str | None = None) -> DataFrame:
        rows = self._staged_rows().where("state = 'staged'")
        rows = rows.where(F.col("object_path") == path) if path else rows
        return versions.staged_in_order(rows).orderBy("object_path", "apply_no")

    def _try(self, path: str, row, kind: str, payload: str, tx_id: str) -> tuple[edits.Applied, list[dict], edits.Tables]:
        t = self._entities(path, row.format_id, row.source_hash)
        if kind not in edits.FORMATS[row.format_id]:
            raise WorkspaceError("unsupported_capability", f"no operation {kind} for {row.format_id}; there are {', '.join(edits.FORMATS[row.format_id])}")
        if row.format_id == "pdf":
            head = t["pdf_documents"].first()
            if head.encrypted or head.signed:
                raise WorkspaceError("format_error", "encrypted and signed files are not edited")
        ops = self.spark.createDataFrame([(tx_id, path, kind, payload)], "op_id string, object_path string, kind string, payload string")
        done = edits.apply_kind(t, ops, row.format_id, kind)
        wrong = done.errors.first()
        if wrong:
            raise WorkspaceError("format_error", wrong.message)
        diffs = [r.asDict() for r in done.diff.collect()]
        if not diffs:
            raise WorkspaceError("format_error", "nothing to change")
        return done, diffs, t

    def edit(self, path: str, kind: str, payload: dict, tx_id: str, expected_hash: str | None = None, actor: str = "editor") -> list[dict]:
        """Check and stage an edit; the file stays as it is. The same transaction again changes nothing."""
        row, _ = self._object(path)
        if expected_hash is not None and expected_hash != row.source_hash:
            raise WorkspaceError("stale_source", path)
        text = json.dumps(payload, sort_keys=True)
        known = self._staged_rows().where((F.col("tx_id") == tx_id) & (F.col("state") != "discarded")).first()
        if known and (known.kind, known.payload, known.object_path) != (kind, text, path):
            raise WorkspaceError("staged_conflict", tx_id)
        if kind == "restore_snapshot":
            diffs = [{"kind": kind, "target": path, "change": "changed", "before": row.source_hash, "after": payload["package_hash"]}]
        else:
            _, diffs, _ = self._try(path, row, kind, text, tx_id)
        if not known:
            self._append("staged", [(tx_id, path, kind, text, actor, now_ms(), row.source_hash, "staged")])
        self._log("edit", path, row.source_hash)
        return diffs

    def _store_snapshot(self, path: str, blob: bytes) -> str:
        whole = packages.digest(blob)
        if self.table("manifests").where(F.col("package_hash") == whole).isEmpty():
            slices = [(path, whole, k, n, s, packages.digest(b), len(b), b) for k, n, s, b in packages.explode(blob)]
            rows = self.spark.createDataFrame(slices, packages.PARTS)
            manifest, parts = packages.snapshot_tables(rows, self.table("parts").select("part_hash"))
            self._append("parts", parts)
            self._append("manifests", manifest)
        return whole

    def snapshot(self, package_hash: str) -> bytes:
        """An earlier state of a file, from its parts."""
        rows = self.table("manifests").where(F.col("package_hash") == package_hash).dropDuplicates(["pos"])
        found = packages.implode_packages(rows, self.table("parts").dropDuplicates(["part_hash"])).first()
        if found is None or not found.intact:
            raise WorkspaceError("snapshot_missing", package_hash)
        return bytes(found.content)

    def apply(self, path: str, tx_id: str) -> int:
        """Write a staged edit into the file; the number of the new version. Applied again it gives the same number."""
        done = self.table("history").where(F.col("tx_id") == tx_id).first()
        if done:
            return done.version
        staged = self._staged_rows().where((F.col("tx_id") == tx_id) & (F.col("state") == "staged") & (F.col("object_path") == path)).first()
        if staged is None:
            raise WorkspaceError("staged_missing", tx_id)
        full = self._path(path)
        with self._lock(path):
            row, _ = self._object(path)
            if row.source_hash != staged.expected_hash:
                raise WorkspaceError("stale_source", path)
            with open(full, "rb") as file:
                before = file.read()
            if packages.digest(before) != row.source_hash:
                raise WorkspaceError("source_changed_during_read", path)
            snapshot = self._store_snapshot(path, before)
            impact: list[str] = []
            revert_of = None
            if staged.kind == "restore_snapshot":
                payload = json.loads(staged.payload)
                after, revert_of = self.snapshot(payload["package_hash"]), payload["version"]
                diffs = [{"kind": staged.kind, "target": path, "change": "changed", "before": snapshot, "after": payload["package_hash"]}]
            else:
                _, diffs, t = self._try(path, row, staged.kind, staged.payload, tx_id)
                try:
                    after = write_back(row.format_id, before, diffs, json.loads(staged.payload))
                except NotWritable as error:
                    raise WorkspaceError("unsupported_capability", str(error)) from error
                if row.format_id == "xlsx":
                    edges = dependencies.formula_edges(t["cells"], t["named_ranges"])
                    touched = t["cells"].where(F.concat("sheet", F.lit("!"), "address").isin([d["target"] for d in diffs]))
                    found = dependencies.impact(edges, touched, t["cells"]).first()
                    impact = found.dependents if found else []
            replace_file(full, after)
            head = self.table("history").where(F.col("object_path") == path).agg(F.max("version").alias("v")).first().v or 0
            self._append("history", [(path, head + 1, tx_id, staged.kind, staged.actor, now_ms(), row.source_hash, packages.digest(after), revert_of, json.dumps(diffs), json.dumps(impact))])
            self._append("staged", [(tx_id, path, staged.kind, staged.payload, staged.actor, now_ms(), staged.expected_hash, "written")])
            self.refresh(glob=path)
        self._log("apply", path, packages.digest(after))
        return head + 1

    def apply_all(self, path: str) -> list[int]:
        """Apply all staged edits of a file in order; each later one is checked against what the earlier ones made."""
        out: list[int] = []
        for row in self.staged(path).collect():
            try:
                current, _ = self._object(path)
                if current.source_hash != row.expected_hash:
                    self._append("staged", [(row.tx_id, path, row.kind, row.payload, row.actor, now_ms(), current.source_hash, "staged")])
                out.append(self.apply(path, row.tx_id))
            except WorkspaceError as error:
                raise WorkspaceError("apply_all_partial", f"applied {out}, {row.tx_id} failed: {error}") from error
        return out

    def recover(self) -> int:
        """Finish what an interruption left: files whose history says one thing and whose index says another are read again."""
        heads = versions.last_writes(self.table("history"), ["object_path"], ["version"], ["after_hash"])
        known = self.objects().select("object_path", "source_hash")
        late = heads.join(known, "object_path").where("after_hash <> source_hash").select("object_path")
        return sum(self.refresh(glob=r.object_path) for r in late.toLocalIterator())

    def close(self, flush: bool = True) -> dict[str, str]:
        """Apply what is staged, file by file, as far as it goes; what failed, by file."""
        failed: dict[str, str] = {}
        if flush:
            for row in self.staged().select("object_path").distinct().collect():
                try:
                    self.apply_all(row.object_path)
                except WorkspaceError as error:
                    failed[row.object_path] = str(error)
        return failed

    def discard(self, path: str, tx_id: str) -> None:
        row = self._staged_rows().where((F.col("tx_id") == tx_id) & (F.col("state") == "staged") & (F.col("object_path") == path)).first()
        if row is None:
            raise WorkspaceError("staged_missing", tx_id)
        self._append("staged", [(tx_id, path, row.kind, row.payload, row.actor, now_ms(), row.expected_hash, "discarded")])

    def history(self, path: str) -> DataFrame:
        return self.table("history").where(F.col("object_path") == path).orderBy("version")

    def diff(self, path: str, version: int) -> list[dict]:
        row = self.table("history").where((F.col("object_path") == path) & (F.col("version") == version)).first()
        if row is None:
            raise WorkspaceError("history_version_missing", f"{path} {version}")
        return json.loads(row.diff)

    def revert(self, path: str, version: int, tx_id: str) -> list[dict]:
        """Stage the state from before a version; applying it makes a new version."""
        row = self.table("history").where((F.col("object_path") == path) & (F.col("version") == version)).first()
        if row is None:
            raise WorkspaceError("history_version_missing", f"{path} {version}")
        return self.edit(path, "restore_snapshot", {"package_hash": row.before_hash, "version": version}, tx_id)


__all__ = ["ReadResponse", "Workspace", "WorkspaceError", "budgeted"]
