"""Schemas that several tests share."""

PLACE = "struct<file_path:string,line:int,column:int>"
NODE = f"id string, type string, display_name string, source_location {PLACE}, repository_name string, project_name string, certainty tinyint, metadata map<string,string>, doc_pos long"
EDGE = NODE.replace("id string, ", "id string, source_id string, target_id string, ", 1)
