"""The schema that rule files must meet, as an XSD that executors check every element by."""

from __future__ import annotations

import tempfile
import zlib
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.casts import VALUE_TYPES
from ..operators.filters import OPERATORS

# Type names of computed values besides those with a cast of their own.
TEXT_TYPES = ("string", "text", "date")

_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
{texts}
<xs:simpleType name="Operator"><xs:restriction base="xs:string"><xs:pattern value="\\s*({operators})\\s*"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Type"><xs:restriction base="xs:string"><xs:pattern value="{types}"/></xs:restriction></xs:simpleType>
<xs:element name="Calculation"><xs:complexType><xs:all>
  <xs:element name="DatasetId" type="DatasetId"/>
  <xs:element name="Keys"><xs:complexType><xs:sequence>
    <xs:element name="Key" type="Key" maxOccurs="unbounded"/>
  </xs:sequence></xs:complexType></xs:element>
  <xs:element name="Filters" minOccurs="0"><xs:complexType><xs:sequence>
    <xs:element name="Filter" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:all>
      <xs:element name="Column" type="Column"/>
      <xs:element name="Operator" type="Operator"/>
      <xs:element name="Value" type="xs:string" minOccurs="0"/>
    </xs:all></xs:complexType></xs:element>
  </xs:sequence></xs:complexType></xs:element>
  <xs:element name="DerivedValues" minOccurs="0"><xs:complexType><xs:all>
    <xs:element name="Column" type="Column"/>
    <xs:element name="GroupFunction" type="xs:string" minOccurs="0"/>
  </xs:all></xs:complexType></xs:element>
  <xs:element name="Values" minOccurs="0"><xs:complexType><xs:sequence>
    <xs:element name="Value" minOccurs="0" maxOccurs="unbounded"><xs:complexType><xs:simpleContent>
      <xs:extension base="Value">
        <xs:attribute name="name" type="ValueName" use="required"/>
        <xs:attribute name="type" type="Type" use="required"/>
      </xs:extension>
    </xs:simpleContent></xs:complexType></xs:element>
  </xs:sequence></xs:complexType></xs:element>
</xs:all></xs:complexType></xs:element>
<xs:element name="DynamicThresholdCalculations"><xs:complexType><xs:sequence>
  <xs:element ref="Calculation" minOccurs="0" maxOccurs="unbounded"/>
</xs:sequence></xs:complexType></xs:element>
</xs:schema>"""


# Errors name the type, so every element with a text that may not be blank has its own.
_TEXT = """<xs:simpleType name="{name}"><xs:restriction base="xs:string">
  <xs:pattern value="\\s*\\S[\\s\\S]*"/>
</xs:restriction></xs:simpleType>"""


def _any_case(names: tuple[str, ...]) -> str:
    """A pattern of the names in either case."""
    return "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name) for name in names)


def schema_text() -> str:
    """The XSD, with the filter operators and value types that this library knows."""
    texts = "\n".join(_TEXT.format(name=name) for name in ("DatasetId", "Key", "Column", "Value", "ValueName"))
    return _XSD.format(texts=texts, operators=_any_case(OPERATORS), types=_any_case((*VALUE_TYPES, *TEXT_TYPES)))


def shipped_schema(spark: SparkSession) -> str:
    """The name under which every executor has the XSD."""
    text = schema_text()
    name = f"rules_{zlib.crc32(text.encode()):08x}.xsd"
    if not any(str(file).endswith(name) for file in spark.sparkContext.listFiles):
        # The driver's copy is only what Spark sends out.
        path = Path(tempfile.mkdtemp(prefix="rules-")) / name
        path.write_text(text)
        spark.sparkContext.addFile(str(path))
    return name
