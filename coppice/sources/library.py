"""Session library: searches appended as JSON, listed, exported and zipped."""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import shutil
import zipfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SESSION = "session_id string, created_at string, mode string, raw_query string, clean_query string, filters string, result string, extra string"


class Library:
    def __init__(self, base: str):
        self.base = base
        for d in ("sessions", "evidence", "osint"):
            os.makedirs(f"{base}/{d}", exist_ok=True)

    def save_session(self, *, mode: str, raw_query: str, clean_query: str, filters: dict, result: dict, extra: dict | None = None, now: str | None = None) -> str:
        """One JSON per session and a line in the index; the id is a hash of time, mode and queries."""
        now = now or datetime.now(timezone.utc).isoformat()
        sid = hashlib.sha1("|".join((now, mode, raw_query, clean_query)).encode()).hexdigest()[:16]
        head = {"session_id": sid, "created_at": now, "mode": mode, "raw_query": raw_query, "clean_query": clean_query}
        with open(f"{self.base}/sessions/{sid}.json", "w") as f:
            json.dump(head | {"filters": filters, "result": result, "extra": extra or {}}, f, ensure_ascii=False)
        with open(f"{self.base}/sessions.jsonl", "a") as f:
            f.write(json.dumps(head, ensure_ascii=False) + "\n")
        return sid

    def append_evidence(self, units: DataFrame, tag: str) -> int:
        """Appends the rows and counts them while they are written."""
        seen = Observation()
        units.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(f"{self.base}/evidence/{_slug(tag)}")
        return seen.get["n"]

    def append_rows(self, rows: list[dict], tag: str) -> int:
        """A search's few collected rows as JSON lines."""
        with open(f"{self.base}/evidence/{_slug(tag)}.jsonl", "a") as f:
            f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)
        return len(rows)

    def save_artifacts(self, session_id: str, artifacts: dict) -> str:
        path = f"{self.base}/osint/{_slug(session_id)}.json"
        with open(path, "w") as f:
            json.dump(artifacts, f, ensure_ascii=False)
        return path

    def sessions(self, spark: SparkSession, *, mode: str | None = None, contains: str | None = None, limit: int | None = None) -> DataFrame:
        """Index lines, newest first; unreadable lines are skipped."""
        rows = spark.read.schema("session_id string, created_at string, mode string, raw_query string, clean_query string").option("mode", "DROPMALFORMED").json(f"{self.base}/sessions.jsonl")
        return listing(rows, mode=mode, contains=contains, limit=limit)

    def load(self, session_id: str) -> dict:
        path = f"{self.base}/sessions/{session_id}.json"
        if not re.fullmatch(r"[\w-]+", session_id) or not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path) as f:
            return json.load(f)

    def ids(self) -> list[str]:
        return sorted(n[:-5] for n in os.listdir(f"{self.base}/sessions") if n.endswith(".json"))

    def export(self, out: str, form: str = "html", ids: list[str] | None = None) -> dict:
        """An index and a page per session; unknown ids are skipped."""
        if form not in ("html", "markdown"):
            raise ValueError("the format is html or markdown")
        os.makedirs(f"{out}/sessions", exist_ok=True)
        known, done = set(self.ids()), []
        ext = "html" if form == "html" else "md"
        for sid in ids if ids is not None else self.ids():
            if sid in known:
                record = self.load(sid)
                with open(f"{out}/sessions/{_slug(sid)}.{ext}", "w") as f:
                    f.write(_page(record) if form == "html" else _markdown(record))
                if graph := (record.get("extra") or {}).get("graph"):
                    with open(f"{out}/sessions/{_slug(sid)}.dot", "w") as f:
                        f.write(dot(graph))
                done.append(record)
        with open(f"{out}/index.{ext}", "w") as f:
            lines = [(r["session_id"], r["created_at"], r["mode"], r["raw_query"]) for r in done]
            f.write("\n".join(f"- [{q}](sessions/{s}.md) {t} {m}" for s, t, m, q in lines) if form != "html" else "<ul>" + "".join(f'<li><a href="sessions/{s}.html">{html.escape(q)}</a> {t} {m}</li>' for s, t, m, q in lines) + "</ul>")
        return {"format": form, "exported_sessions": len(done), "output_dir": out}

    def publish(self, out_zip: str, form: str = "html", ids: list[str] | None = None) -> str:
        tmp = out_zip + ".dir"
        meta = self.export(tmp, form, ids)
        with open(f"{tmp}/bundle_meta.json", "w") as f:
            json.dump({k: v for k, v in meta.items() if k != "output_dir"}, f)
        with zipfile.ZipFile(out_zip, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, names in os.walk(tmp):
                for n in sorted(names):
                    z.write(os.path.join(root, n), os.path.relpath(os.path.join(root, n), tmp))
        shutil.rmtree(tmp)
        return out_zip

    def delete_all(self) -> None:
        shutil.rmtree(self.base, ignore_errors=True)


def listing(rows: DataFrame, *, mode: str | None = None, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions of a mode whose queries contain a text, newest first; rows without an id are skipped."""
    rows = rows.where(F.col("session_id").isNotNull())
    if mode:
        rows = rows.where(F.col("mode") == mode)
    if contains:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "raw_query", "clean_query")), F.lit(contains.lower())))
    rows = rows.orderBy(F.desc("created_at"), "session_id")
    return rows if limit is None else rows.limit(limit)


def _slug(text: str) -> str:
    return re.sub(r"[^\w-]+", "_", text).strip("_") or "x"


def _rows(record: dict) -> list[dict]:
    return (record.get("result") or {}).get("evidence") or []


def _page(r: dict) -> str:
    e = lambda x: html.escape(str(x if x is not None else ""))
    table = "".join(f"<tr><td>{e(x.get('verdict'))}</td><td>{e(x.get('score'))}</td><td>{e(x.get('citation_id'))}</td><td>{e(x.get('content'))}</td></tr>" for x in _rows(r))
    return f"<!doctype html><meta charset=utf-8><title>{e(r['raw_query'])}</title><h1>{e(r['raw_query'])}</h1><p>{e(r['mode'])} {e(r['created_at'])}</p><p>{e((r.get('result') or {}).get('answer'))}</p><table>{table}</table>"


def _markdown(r: dict) -> str:
    lines = [f"# {r['raw_query']}", "", f"{r['mode']} {r['created_at']}", "", str((r.get("result") or {}).get("answer") or ""), ""]
    return "\n".join(lines + [f"- **{x.get('verdict')}** {x.get('content')} (`{x.get('citation_id')}`)" for x in _rows(r)])


def dot(graph: dict, nodes: int = 400, edges: int = 800) -> str:
    """Graphviz text of a graph {nodes, edges}, a shape for each type of node."""
    q = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    shapes = {"query": "diamond", "url": "box", "domain": "ellipse"}
    out = [f"  {q(n['node_id'])} [label={q(n['label'])}, shape={shapes.get(n['node_type'], 'plain')}];" for n in graph["nodes"][:nodes]]
    out += [f"  {q(x['source'])} -> {q(x['target'])} [label={q(x['edge_type'])}];" for x in graph["edges"][:edges]]
    return "\n".join(["digraph g {", *out, "}"])
