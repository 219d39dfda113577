"""GraphML as a data source: files are read in byte ranges at element starts and written as parts that appear together.

    spark.dataSource.register(GraphML)
    spark.read.format("graphml").load(path)              # a file, or a folder that this source wrote
    df.write.format("graphml").mode("append").save(path)

Rows: kind (node or edge), id, src, tgt, weight, entity_type, description, keywords, source_id. Paths go through Arrow's file systems (local and mounted folders, HDFS, S3,
GCS). Elements are found by their names, so node and edge elements inside comments or CDATA sections aren't told apart from others."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import islice
from xml.sax.saxutils import quoteattr, escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "kind string, id string, src string, tgt string, weight double, entity_type string, description string, keywords string, source_id string"
#: Bytes of a range, and of a read inside it.
RANGE, CHUNK = 32 << 20, 1 << 20
#: Tasks of a read, about: a larger folder has several ranges in a row to a task (but no more than RANGE bytes). Rows of a batch.
TASKS, ROWS = 256, 8192
_ARROW = pa.schema([(n, pa.float64() if kind == "double" else pa.string()) for n, kind in (c.split() for c in SCHEMA.split(", "))])
_FIELDS = ("entity_type", "description", "keywords", "source_id")
_BEGIN = re.compile(rb"<(node|edge)(?=[\s/>])")
_TAG = re.compile(rb"<(?:node|edge)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>")
_ATTR = re.compile(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_DATA = re.compile(r"<data\b([^>]*?)(?:/>|>(.*?)</data\s*>)", re.S)
_KEY = re.compile(r"<key\b([^>]*)>")
_MANIFEST = "_MANIFEST"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _attributes(raw: str) -> dict[str, str]:
    return {k: unescape(a or b) for k, a, b in _ATTR.findall(raw)}


def _bare(value: str | None) -> str | None:
    """Without the quotes that surround a value."""
    return value.strip('"') if value is not None else None


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    keys: dict  # (element, data key) -> field


def _row(kind: str, element: str, keys: dict) -> tuple:
    tag = re.match(r"<\w+((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", element)
    own = _attributes(tag.group(1)) if tag else {}
    data = {}
    for attrs, body in _DATA.findall(element):
        key = _attributes(attrs).get("key", "")
        data[keys.get(f"{kind}:{key}", key)] = unescape(body)
    weight = None
    if kind == "edge":
        try:
            weight = float(_bare(data.get("weight", "")) or 0)
        except ValueError:
            weight = 0.0
    return (kind, _bare(own.get("id")) if kind == "node" else None, _bare(own.get("source")), _bare(own.get("target")), weight, *(_bare(data.get(f)) for f in _FIELDS))


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        kind = options.get("kind")  # node or edge: the others are passed over unread
        self.begin = re.compile(rb"<(%s)(?=[\s/>])" % kind.encode()) if kind else _BEGIN

    def files(self) -> list[str]:
        """The file, or the parts that the folder's manifests name."""
        store, at = _open(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [at]
        names = []
        for f in store.get_file_info(fs.FileSelector(at)):
            if f.base_name.startswith(_MANIFEST):
                with store.open_input_stream(f.path) as s:
                    names += json.loads(s.read())
        return [f"{at}/{n}" for n in sorted(names)]

    def partitions(self) -> list[Range]:
        store, _ = _open(self.path)
        out = []
        sizes = {f: store.get_file_info(f).size for f in self.files()}
        wide = min(-(-sum(sizes.values()) // TASKS), max(RANGE, self.range))
        wide = self.range * max(-(-wide // self.range), 1)
        for f, size in sizes.items():
            with store.open_input_file(f) as s:
                head = b""
                while len(head) < size and not _BEGIN.search(head):
                    more = s.read(CHUNK)
                    if not more:
                        break
                    head += more
            found = _BEGIN.search(head)
            keys = {}
            for raw in _KEY.findall(head[: found.start() if found else len(head)].decode("utf-8", "replace")):
                a = _attributes(raw)
                for kind in (a.get("for", "all"),) if a.get("for") in ("node", "edge") else ("node", "edge"):
                    keys[f"{kind}:{a.get('id', '')}"] = a.get("attr.name", "")
            out += [Range(f, lo, min(lo + wide, size), keys) for lo in range(0, size, wide)]
        return out or [Range("", 0, 0, {})]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = self.elements(partition)
        while some := list(islice(rows, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ARROW.types)], schema=_ARROW)

    def elements(self, partition: Range) -> Iterator[tuple]:
        """The elements that begin in the range; the last one is read to its end behind it."""
        if partition.begin >= partition.end:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as s:
            size = s.size()
            s.seek(partition.begin)
            held, at, offset = b"", 0, partition.begin  # offset: place of held[0]

            def more() -> bool:
                nonlocal held, at, offset
                new = s.read(CHUNK)
                if at:
                    held, offset, at = held[at:], offset + at, 0
                held += new
                return bool(new)

            more()
            while True:
                m = self.begin.search(held, at)
                if not m:
                    at = max(at, len(held) - 6)  # a name may be cut by the end of the chunk
                    if offset + at >= min(partition.end, size) or not more():
                        return
                    continue
                if offset + m.start() >= partition.end:
                    return
                at, kind = m.start(), m.group(1)
                while not (tag := _TAG.match(held, at)):
                    if not more():
                        return
                close = tag.end()
                if not tag.group(2):
                    last = b"</" + kind + b">"
                    while (k := held.find(last, at)) < 0:
                        if not more():
                            return
                    close = k + len(last)
                yield _row(kind.decode(), held[at:close].decode("utf-8", "replace"), partition.keys)
                at = close


@dataclass
class Part(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    """Parts are whole GraphML documents under names that nobody reads until the manifest of the job names them."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.graphml"
        keys = {("node", "entity_type"): "d0", ("node", "description"): "d1", ("node", "source_id"): "d2", ("edge", "weight"): "d3", ("edge", "description"): "d4", ("edge", "keywords"): "d5", ("edge", "source_id"): "d6"}
        head = "".join(f'<key id="{k}" for="{kind}" attr.name="{n}" attr.type="{"double" if n == "weight" else "string"}"/>\n' for (kind, n), k in keys.items())
        with store.open_output_stream(f"{at}/{name}") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n{head}<graph edgedefault="undirected">\n'.encode())
            for b in iterator:
                lines = []
                for r in b.to_pylist():
                    kind = r["kind"]
                    own = f"id={quoteattr(r['id'] or '')}" if kind == "node" else f"source={quoteattr(r['src'] or '')} target={quoteattr(r['tgt'] or '')}"
                    data = "".join(f'<data key="{k}">{escape(str(r[n]))}</data>' for (of, n), k in keys.items() if of == kind and r.get(n) is not None)
                    lines.append(f"<{kind} {own}>{data}</{kind}>\n")
                out.write("".join(lines).encode())
            out.write(b"</graph>\n</graphml>\n")
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        """One manifest for the job, written under another name and moved: all parts appear at once."""
        store, at = _open(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/.new-{self.job}") as out:
            out.write(json.dumps([m.name for m in messages if m]).encode())
        store.move(f"{at}/.new-{self.job}", f"{at}/{_MANIFEST}-{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        """Parts of a failed job go, those of its failed tasks too."""
        store, at = _open(self.path)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            for f in store.get_file_info(fs.FileSelector(at)):
                if f.base_name.startswith(f"part-{self.job}-"):
                    store.delete_file(f.path)


class GraphML(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("append to a new folder: a graph is replaced by naming another one")
        return Writer(self.options)
