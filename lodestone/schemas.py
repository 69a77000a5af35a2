"""Explicit schemas of the tables that the engine reads and writes."""

from __future__ import annotations

METADATA = (
    "struct<title:string,page_start:int,page_end:int,source_pages:array<int>,product_category:string,section:string,"
    "content_type:string,model_names:array<string>,error_codes:array<string>,char_count:int>"
)
RAW = "doc_id string, raw string"
PAGES = "doc_id string, page_ord int, page_num int, text string"
CHUNKS = f"chunk_id string, text string, metadata {METADATA}"
UNDERSTANDING = (
    "translated_query string, language string, is_roman_urdu boolean, error_codes array<string>, model_names array<string>,"
    "intent string, product_category string, confidence double"
)
SOURCES = "array<struct<title:string,page:int,section:string,documentType:string,url:string>>"
LAYOUT_ITEMS = (
    "doc_id string, item_ord int, level int, type string, label string, page int, content string,"
    "bbox struct<l:double,t:double,r:double,b:double>"
)
