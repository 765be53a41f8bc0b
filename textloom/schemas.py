"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


TEXT, INT, LONG, BOOL = StringType(), IntegerType(), LongType(), BooleanType()
SAMPLE = _struct(file=TEXT, line=INT, code=TEXT)
FILES = _struct(path=TEXT, lang=TEXT, ext=TEXT, n_bytes=LONG, text=TEXT)
LINES = _struct(path=TEXT, lang=TEXT, line_no=INT, line=TEXT)
CAPTURE = _struct(text=TEXT, s_line=INT, s_col=INT)
MATCHES = _struct(rule_id=TEXT, path=TEXT, s_line=INT, s_col=INT, e_line=INT, e_col=INT, code=TEXT, captures=MapType(TEXT, CAPTURE))
REGIONS = _struct(path=TEXT, kind=TEXT, s_line=INT, s_col=INT, e_line=INT, e_col=INT, header=TEXT)
#: A node lies in another of its file if ``pre`` and ``post`` lie between the other's; ``scope`` is the ``pre`` of the innermost function around it, ``leaves``
#: whether what follows it in its block is never reached (of a block: its end).
NODES = _struct(path=TEXT, lang=TEXT, pre=INT, post=INT, parent=INT, scope=INT, kind=TEXT, name=TEXT, s_line=INT, s_col=INT, e_line=INT, e_col=INT, code=TEXT, leaves=BOOL)
OCCURRENCES = _struct(lang=TEXT, category=INT, rule_id=TEXT, path=TEXT, line_no=INT, code=TEXT)
FLOW = _struct(rule_id=TEXT, path=TEXT, line_no=INT, code=TEXT, trail=ArrayType(TEXT))
FINDINGS = _struct(lang=TEXT, category=INT, rule_id=TEXT, severity=TEXT, n=LONG, title=TEXT, description=TEXT, samples=ArrayType(SAMPLE))
SUMMARY = _struct(lang=TEXT, files=LONG, critical=LONG, warning=LONG, info=LONG)
TOTALS = _struct(files=LONG, critical=LONG, warning=LONG, info=LONG)
#: A combined report as other scanners or earlier runs leave it; counts may be missing or no numbers.
REPORT = _struct(project=TEXT, timestamp=TEXT, totals=MapType(TEXT, TEXT), scanners=ArrayType(MapType(TEXT, TEXT)))
#: One match of a structural matcher, as JSON text.
_POINT = _struct(line=INT, row=INT, column=INT)
MATCH_JSON = _struct(
    ruleId=TEXT, rule_id=TEXT, file=TEXT, path=TEXT, text=TEXT, lines=TEXT, severity=TEXT, message=TEXT,
    range=_struct(start=_POINT, end=_POINT),
    metaVariables=_struct(single=MapType(TEXT, _struct(text=TEXT, range=_struct(start=_POINT, end=_POINT)))),
)
CASE = _struct(id=TEXT, path=TEXT, language=TEXT, description=TEXT, tags=ArrayType(TEXT), enabled=BOOL, expect=_struct(exit_code=TEXT, totals=MapType(TEXT, MapType(TEXT, LONG)), require=ArrayType(TEXT), forbid=ArrayType(TEXT)))
