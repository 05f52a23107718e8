"""Schemas of the wire format, as DDL."""

ENTITY = "struct<name:string,type:string,line:int,start_line:int,end_line:int>"
RELATION = (
    "struct<type:string,source:string,target:string,target_type:string,line:int,confidence:string,layer:string,status:string,symbol_id:string,target_ref:string,package:string,language:string>"
)
EVENT = f"struct<type:string,path:string,old_path:string,project:string,machine_id:string,timestamp:bigint,content_hash:string,content:string,entities:array<{ENTITY}>,relations:array<{RELATION}>>"
EVENT_LIST = f"array<{EVENT}>"
BATCH = f"struct<machine_id:string,project:string,events:{EVENT_LIST},sent_at:bigint>"
RANKED = "map<string,array<struct<id:string,score:double,file_path:string,entity:string>>>"
#: Fields of a search result; further ones may be added.
SEARCH_RESULT = "file_path string, machine_id string, project string, snippet string, score double, matched_entities array<string>"
