"""Schemas of the engine's tables, as Spark DDL."""

GLYPH = "paper_id string, page int, index int, text string, fontname string, x0 double, x1 double, top double, bottom double, size double, upright boolean"
PAGE = "paper_id string, page int, width double, height double"
IMAGE = "paper_id string, page int, index int, x0 double, top double, x1 double, bottom double, width double, height double"
FONT_CODE = "paper_id string, font string, code int, ch string"
TOKEN = "struct<token_id:string, line_id:string, kind:string, surface:string, identity_key:string, style:string, status:string, bbox:array<double>>"
LINE = "struct<line:int, line_id:string, text:string, bbox:array<double>, definition_like:boolean, formula_like:boolean, heading:boolean, has_token:boolean>"
CANDIDATE = "struct<token_id:string, line:int, line_id:string, surface:string, surface_normalized:string, status:string, style:string, bbox:array<double>, font:string, font_family:string, size:double>"
SYMBOL = "struct<surface:string, identity_key:string, style:string, status:string, level:int, types:array<string>, token_ids:array<string>, texts:array<string>>"
EVENT = f"struct<definition_id:string, line_ids:array<string>, text:string, bbox:array<double>, trigger:string, window:array<int>, symbols:array<{SYMBOL}>>"
EVENTS = f"struct<events:array<{EVENT}>, claimed:array<int>>"
#: Events are found twice: as on a page before the references, and as on one behind them.
PARSED_PAGE = f"paper_id string, page int, boundary double, lines array<{LINE}>, tokens array<{TOKEN}>, candidates array<{CANDIDATE}>, open {EVENTS}, closed {EVENTS}"
FOLDER = "folder_id string, name string"
MEMBERSHIP = "folder_id string, paper_id string"
