"""Schemas of the tables that operators give. Field names and kinds are fixed values: other tools read the same names."""

SPAN = "struct<start_byte:bigint,end_byte:bigint,start_line:bigint,start_column:bigint,end_line:bigint,end_column:bigint>"
NODES = (
    "doc_id long, node_id int, subtree_last int, parent_id int, child_index int, depth int, kind string, field string, is_named boolean, is_error boolean, "
    "is_missing boolean, is_extra boolean, has_error boolean, ancestors array<int>, start_byte long, end_byte long, start_line long, start_column long, end_line long, end_column long"
)
ITEMS = {
    "structure": f"item_id:int,parent_item_id:int,depth:int,ordinal:int,kind:string,kind_other:string,name:string,visibility:string,span:{SPAN},body_span:{SPAN},decorators:array<string>,doc_comment:string,signature:string",
    "imports": f"source:string,items:array<string>,alias:string,is_wildcard:boolean,span:{SPAN}",
    "exports": f"name:string,kind:string,span:{SPAN}",
    "comments": f"text:string,kind:string,span:{SPAN},associated_node:string",
    "docstrings": f"text:string,format:string,format_other:string,span:{SPAN},associated_item:string,parsed_sections:array<struct<kind:string,name:string,description:string>>",
    "symbols": f"name:string,kind:string,kind_other:string,span:{SPAN},type_annotation:string,doc:string",
    "diagnostics": f"message:string,severity:string,span:{SPAN}",
    "data": f"node_id:int,parent_id:int,depth:int,ordinal:int,kind:string,key:string,value:string,attributes:array<struct<name:string,value:string,span:{SPAN}>>,span:{SPAN}",
    "chunks": f"chunk_index:int,total_chunks:int,content:string,start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint,language:string,node_types:array<string>,context_path:array<string>,symbols_defined:array<string>,comments:array<struct<text:string,kind:string,span:{SPAN},associated_node:string>>,docstrings:array<struct<text:string>>,has_error_nodes:boolean",
}
FAMILIES = ("structure", "imports", "exports", "comments", "docstrings", "symbols", "diagnostics")
SPAN_FIELDS = ("start_byte", "end_byte", "start_line", "start_column", "end_line", "end_column")


def array_of(family: str) -> str:
    return f"array<struct<{ITEMS[family]}>>"
