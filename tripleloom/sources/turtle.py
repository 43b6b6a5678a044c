"""Turtle (and its subset N3 as far as plain graphs go): a parser after the W3C grammar, run over the lines of one file in a task."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.iri import resolve
from tripleloom.functions.xsd import RDF, XSD
from tripleloom.runtime import ready
from tripleloom.sources.ntriples import globbed

Node = tuple[str, str, str, str]  # kind, lex, lang, dt

_TOKENS = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)
|(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+>)
|(?P<string>\"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''|"(?:[^"\\\n\r]++|\\.)*+"|'(?:[^'\\\n\r]++|\\.)*+')
|(?P<directive>@prefix\b|@base\b|(?:PREFIX|BASE|prefix|base)(?=\s))
|(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
|(?P<blank>_:\w(?:[\w.·-]*[\w·-])?)
|(?P<double>[+-]?(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+)
|(?P<decimal>[+-]?\d*\.\d+)
|(?P<integer>[+-]?\d+)
|(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
|(?P<word>a\b|true\b|false\b)
|(?P<op>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
#: A string that is still open where the text read so far ends: the next lines tell whether it is one.
_OPEN = re.compile(r"""(?:\"\"\"(?:[^"\\]++|\\.|"(?!""))*+|'''(?:[^'\\]++|\\.|'(?!''))*+|"(?:[^"\\\n\r]++|\\.)*+|'(?:[^'\\\n\r]++|\\.)*+)\\?\Z""", re.S)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\", ">": ">"}


class TurtleError(ValueError):
    """A statement that doesn't follow the grammar."""


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            code = int(m[1] or m[2], 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise TurtleError(f"no character {m[0]}")
            return chr(code)
        if m[3] not in _ESCAPES:
            raise TurtleError(f"unknown escape \\{m[3]}")
        return _ESCAPES[m[3]]

    return re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\(.)", one, text, flags=re.S) if "\\" in text else text


class Turtle:
    """Iterates over the statements of a document: (subject, predicate, object), or a string for a piece that fails.

    After a failure reading goes on in the next line. Blank node labels are made unique by ``scope``. ``more``: what follows the
    text, in pieces of whole lines, as the text itself then is; they are taken as needed and dropped when their statements end."""

    def __init__(self, text: str, scope: str = "", base: str = "", more: Iterable[str] = ()):
        self.text, self.scope, self.base, self.more = text, scope, base, iter(more)
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.fresh = 0
        self.token: tuple[str, str] = ("", "")
        self.out: list[tuple[Node, Node, Node]] = []

    def __iter__(self) -> Iterator[tuple[Node, Node, Node] | str]:
        while True:
            if self.at >= max(CHUNK, len(self.text) // 2):
                self.text, self.at = self.text[self.at :], 0
            start = self.at
            self.out = []
            try:
                self.next()
                if self.token[0] == "end":
                    return
                self.statement()
                yield from self.out
            except TurtleError as e:
                stop = self.text.find("\n", max(start, self.at - len(self.token[1])))
                stop = len(self.text) if stop < 0 else stop + 1
                yield f"{e}: {self.text[start:stop].strip()[:200]}"
                self.at = max(stop, start + 1)

    def fill(self) -> bool:
        """Reads on; no less than there is already, so that a long statement's text is copied a few times only. False at the end."""
        pieces, n = [self.text], 0
        for piece in self.more:
            pieces.append(piece)
            n += len(piece)
            if n >= max(CHUNK, len(self.text)):
                break
        self.text = "".join(pieces)
        return n > 0

    def next(self) -> None:
        while True:
            if self.at >= len(self.text) and not self.fill():
                self.token = ("end", "")
                return
            if self.text[self.at] in "\"'":
                while _OPEN.match(self.text, self.at) and self.fill():
                    pass
            m = _TOKENS.match(self.text, self.at)
            if m is None:
                self.token = ("", "")
                raise TurtleError(f"unexpected {self.text[self.at]!r}")
            self.at = m.end()
            if m.lastgroup != "space":
                self.token = (m.lastgroup or "", m.group())
                return

    def take(self, value: str) -> bool:
        if self.token == ("op", value):
            self.next()
            return True
        return False

    def need_dot(self) -> None:
        if self.token != ("op", "."):
            raise TurtleError(f"dot expected, not {self.token[1] or 'the end'!r}")

    def statement(self) -> None:
        kind, value = self.token
        if kind == "directive":
            self.directive(value)
            return
        alone = self.token == ("op", "[")
        s = self.subject()
        if not (alone and self.token == ("op", ".")):
            self.properties(s)
        self.need_dot()

    def directive(self, word: str) -> None:
        self.next()
        if word.lower().endswith("prefix"):
            kind, name = self.token
            if kind != "pname" or not name.endswith(":"):
                raise TurtleError("prefix expected")
            self.next()
            self.prefixes[name[:-1]] = self.iri()
        else:
            self.base = self.iri()
        if word.startswith("@"):
            self.next()
            self.need_dot()

    def iri(self) -> str:
        """The IRI at the current token; the token isn't passed."""
        kind, value = self.token
        if kind == "iri":
            return resolve(self.base, _unescape(value[1:-1]))
        if kind == "pname":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise TurtleError(f"IRI expected, not {value or 'the end'!r}")

    def new_blank(self) -> Node:
        self.fresh += 1
        return ("B", f"{self.scope}g{self.fresh}", "", "")

    def subject(self) -> Node:
        kind, value = self.token
        if kind == "blank":
            node = ("B", self.scope + value[2:], "", "")
        elif self.token in (("op", "["), ("op", "(")):
            return self.nested()
        else:
            node = ("I", self.iri(), "", "")
        self.next()
        return node

    def nested(self) -> Node:
        if self.take("["):
            node = self.new_blank()
            if not self.take("]"):
                self.properties(node)
                if not self.take("]"):
                    raise TurtleError("] expected")
            return node
        self.take("(")
        items = []
        while not self.take(")"):
            items.append(self.object())
        rest: Node = ("I", RDF + "nil", "", "")
        for item in reversed(items):
            node = self.new_blank()
            self.out += [(node, ("I", RDF + "first", "", ""), item), (node, ("I", RDF + "rest", "", ""), rest)]
            rest = node
        return rest

    def properties(self, s: Node) -> None:
        while True:
            p: Node = ("I", RDF + "type" if self.token == ("word", "a") else self.iri(), "", "")
            self.next()
            while True:
                o = self.object()
                self.out.append((s, p, o))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.token in (("op", "."), ("op", "]")):
                return

    def object(self) -> Node:
        kind, value = self.token
        if kind in ("integer", "decimal", "double"):
            self.next()
            return ("L", value, "", XSD + kind)
        if kind == "word" and value != "a":
            self.next()
            return ("L", value, "", XSD + "boolean")
        if kind != "string":
            return self.subject()
        lex = _unescape(value[3:-3] if value[:3] in ('"""', "'''") and len(value) >= 6 else value[1:-1])
        self.next()
        kind, value = self.token
        if kind == "lang":
            self.next()
            return ("L", lex, value[1:], "")
        if self.take("^^"):
            dt = self.iri()
            self.next()
            return ("L", lex, "", dt)
        return ("L", lex, "", "")


#: Characters that are read at a time.
CHUNK = 1 << 18
#: A file is read by one task.
MAX_BYTES = 512 << 20

_NODE = "struct<kind:string,lex:string,lang:string,dt:string>"


def read_turtle(spark: SparkSession, path: str, glob: str = globbed("ttl", "n3", "nt")) -> DataFrame:
    """s, p, o (structs kind, lex, lang, dt), corrupt, file_name. A piece that can't be read has nulls and the reason with its
    text in ``corrupt``. A file is read by one task, as prefixes hold to its end, line by line: a task holds a statement, not the
    file. Blank node labels are unique to a file. ValueError for files of more than ``MAX_BYTES``: they must be split at a
    statement's end, with the prefixes repeated, or be given as N-Triples, which is read in any number of splits."""
    ready(spark)
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", glob or "*").load(path).select("path", "length")
    large = [r["path"] for r in sizes.where(F.col("length") > MAX_BYTES).limit(5).collect()]
    if large:
        raise ValueError(f"too large to be read as a whole: {', '.join(large)}")
    reader = spark.read.option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    # Ranges by lines rather than a hash: files are dealt evenly. The number is given, as parts that are merged make fewer tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = lines.repartitionByRange(parts, "file_name").sortWithinPartitions("file_name", "block", "row").select("file_name", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for name, own in groupby(each, itemgetter(0)):
            good, bad, size = [], [], 0
            for got in Turtle("", f"f{abs(hash_text(name)):x}_", more=(x + "\n" for _, x in own)):
                (bad if isinstance(got, str) else good).append(got)
                size += 0 if isinstance(got, str) else len(got[2][1])
                if len(good) + len(bad) >= 10_000 or size >= 1 << 24:
                    yield _batch(good, bad, name)
                    good, bad, size = [], [], 0
            if good or bad:
                yield _batch(good, bad, name)

    return files.mapInArrow(run, f"s {_NODE}, p {_NODE}, o {_NODE}, corrupt string, file_name string")


def _batch(good: list[tuple[Node, Node, Node]], bad: list[str], name: str) -> pa.RecordBatch:
    """Statements and failures of a file as rows."""
    text, names = pa.string(), ("kind", "lex", "lang", "dt")
    none = pa.nulls(len(bad), pa.struct([(x, text) for x in names]))
    columns = [pa.concat_arrays([pa.StructArray.from_arrays([pa.array([s[i][k] for s in good], text) for k in range(4)], names), none]) for i in range(3)]
    corrupt = pa.concat_arrays([pa.nulls(len(good), text), pa.array(bad, text)])
    return pa.RecordBatch.from_arrays([*columns, corrupt, pa.array([name] * len(corrupt), text)], ["s", "p", "o", "corrupt", "file_name"])


def hash_text(text: str) -> int:
    """A hash that is the same in every process."""
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode(), digest_size=6).digest(), "big")
