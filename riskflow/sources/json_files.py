"""JSON files whose records are read one after another.

A file is one document: a record, or an array of records of any length. Its text is read in
pieces and scanned for where each record ends, so memory holds one piece or one record,
whatever the file's size. Records keep their text as it is.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import files_in, located

PIECE = 1 << 20
# Characters after which a record that does not end is given up.
LONGEST_RECORD = 1 << 28
WHITE_SPACE = " \t\n\r"
ENDS_VALUE = tuple(WHITE_SPACE + ",]")


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


# Values are only looked at to find their end; numbers stay texts of any length.
_VALUES = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_number)


class Scanner:
    """A position in a text of which pieces arrive when they are needed."""

    def __init__(self, pieces: Iterator[str], longest: int = LONGEST_RECORD) -> None:
        self._pieces, self._longest = pieces, longest
        self._text, self._at, self._ended = "", 0, False

    def records(self) -> Iterator[str]:
        """The records of the document; raises where it is not exactly one JSON value."""
        if not self._next():
            return
        if self._next() != "[":
            yield self._value()
        else:
            self._at += 1
            if self._next() != "]":
                yield self._value()
                while self._next() == ",":
                    self._at += 1
                    self._next()
                    yield self._value()
            if self._next() != "]":
                raise ValueError("an array does not go on")
            self._at += 1
        if self._next():
            raise ValueError("something follows the document")

    def _more(self) -> bool:
        """Read as much again as is left, at least a piece."""
        rest = self._text[self._at :]
        parts, size = [rest], 0
        while size < max(len(rest), 1):
            piece = next(self._pieces, None)
            if piece is None:
                self._ended = True
                break
            parts.append(piece)
            size += len(piece)
        self._text, self._at = "".join(parts), 0
        return size > 0

    def _next(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            while self._at < len(self._text):
                if self._text[self._at] not in WHITE_SPACE:
                    return self._text[self._at]
                self._at += 1
            if not self._more():
                return ""

    def _value(self) -> str:
        while True:
            try:
                end = _VALUES.raw_decode(self._text, self._at)[1]
            except RecursionError:
                raise ValueError("a record is nested too deeply") from None
            except ValueError:
                end = None
            # A number may go on in the next piece, also after a sign in it.
            if end is not None and (self._ended or self._text[end : end + 1] in ENDS_VALUE):
                text = self._text[self._at : end]
                self._at = end
                return text
            if len(self._text) - self._at > self._longest:
                raise ValueError("a record does not end")
            if not self._more() and end is None:
                raise ValueError("a record is no JSON")


def split_document(text: str) -> list[str] | None:
    """The records of a document as texts; None where it is not exactly one JSON value."""
    try:
        return list(Scanner(iter([text]), max(len(text), 1)).records()) or ([] if text.strip(WHITE_SPACE) else None)
    except ValueError:
        return None


def _pieces(path: str) -> Iterator[str]:
    files, inner = located(path)
    decoder = codecs.getincrementaldecoder("utf-8")()
    with files.open_input_stream(inner) as stream:
        while data := stream.read(PIECE):
            if text := decoder.decode(data):
                yield text
    decoder.decode(b"", final=True)


class RecordReader(DataSourceReader):
    """One task per file."""

    def __init__(self, options: dict[str, Any]) -> None:
        self._path = options["path"]
        self._strict = options.get("strict", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in files_in(self._path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        if not self._strict:
            # Whether a document is good is known at its end only.
            try:
                for _ in Scanner(_pieces(path)).records():
                    pass
            except ValueError:
                return
        held, size = [], 0
        for record in Scanner(_pieces(path)).records():
            held.append(record)
            size += len(record)
            if size >= PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["data"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["data"])


class JsonFiles(DataSource):
    """Records of JSON files as texts, in column ``data``."""

    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "data string"

    def reader(self, schema: Any) -> RecordReader:
        return RecordReader(dict(self.options))
