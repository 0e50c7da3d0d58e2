"""Schemas of the records that the operators exchange."""

USE = "struct<file_path:string,method_nm:string,method_defn:string,usage:array<string>,method_end:string>"
METHOD = (
    "struct<method_name:string,method_begin:string,method_end:string,api_end_points:array<string>,range_start:int,range_end:int,"
    f"global_uses:array<{USE}>,local_uses:array<{USE}>,low_prob_global_uses:array<{USE}>,local_api_call:array<string>,inter_service_api_call:array<string>>"
)
#: One document a code base: its files' methods and calls.
SUMMARY = f"map<string,struct<method_details_:array<{METHOD}>,inter_service_api_call:array<string>,global_usage_local_api_call:array<string>>>"
FILES = "service string, lang string, path string, content string, mtime timestamp"
LINE_FACTS = "lineno int, type string, targets array<string>, ending int, `values` array<string>, function string"
METHODS = "name string, start_line int, end_line int, api_end_point string"
HUNKS = "file string, old_start int, old_length int, new_start int, new_length int, old_code array<string>, new_code array<string>"
NODES = "id string, file_path string, method_name string, method_begin int, method_end int, api_end_points array<string>, importance double"
EDGES = "src string, dst string, usage_type string, method_nm string, snippet string, weight double"
IMPACT = "struct<impacted_method:string,impacted_code_snippet:array<string>,impacted_code_range:array<int>,impacted_code_context:string,criticality:int,impact_analysis:string,impact_type:string>"
