"""Schemas of the logical relations; every relation starts with ``paper_id``, so that a job holds many papers."""

SOURCES = "paper_id string, source_path string, sha256 string, size long, mtime double, metadata map<string,string>"
SECTIONS = "paper_id string, section_index int, section_title string, page int, paragraph_index int, level int, kind string"
CITATIONS = (
    "paper_id string, marker string, marker_raw string, kind string, sentence string, page int, paragraph_index int, line_in_paragraph int, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, reference_number int, author string, year string, ref_key string, "
    "ref_candidates array<string>, section_title string, section_index int"
)
TARGET = "struct<key:string,doi:string,arxiv_id:string,openalex_id:string,semantic_scholar_id:string>"
METADATA = (
    "struct<title:string,authors:array<string>,year:string,doi:string,arxiv_id:string,openalex_id:string,semantic_scholar_id:string,venue:string,"
    f"abstract:string,citation_count:long,reference_targets:array<{TARGET}>>"
)
COMPARISON = (
    "struct<title_match:boolean,title_similarity:double,author_match:boolean,author_similarity:double,year_match:boolean,is_match:boolean,confidence:double,"
    "issues:array<string>,source:string>"
)
VALIDATION = f"struct<is_valid:boolean,confidence:double,issues:array<string>,source:string,sources_checked:array<string>,comparison:{COMPARISON},metadata:{METADATA}>"
REFERENCES = (
    "paper_id string, key string, title string, author string, year string, doi string, arxiv_id string, entry_type string, reference_number int, "
    f"raw string, source string, pos int, validation {VALIDATION}"
)
EDGES = "paper_id string, src string, dst string"
LITERATURE = (
    "source string, title string, authors array<string>, year string, doi string, arxiv_id string, url string, abstract string, citation_count long, venue string"
)
CANDIDATES = "paper_id string, pos int, title string, authors array<string>, year string, citation_count long, venue string, doi string, url string, abstract string"
TREND = "paper_id string, year int, cnt long"
JUDGMENTS = "paper_id string, pos int, citation_marker string, ref_key string, judgment string, note string"
VOTES = "paper_id string, sub_id string, model string, pos int, score double"
SUB_SCORES = "paper_id string, agent string, sub_id string, score double, risk string, reasoning string"
EVALUATIONS = "paper_id string, agent_name string, dimension string, score double, reasoning string, confidence double"
METRICS = "paper_id string, metric_id string, value double"
