"""The records of the pipeline."""

METADATA = (
    "struct<company:string,title:string,location:string,start_date:string,end_date:string,name:string,project_type:string,repository:string,date:string,technologies:array<string>,email:string,phone:string,linkedin:string,"
    "github:string,summary:string,skills:array<string>,institution:string,degree:string,field:string,graduation_date:string,achievements:array<string>,issuer:string>"
)
_SOURCE = "source_file string, source_type string"
METRICS = "array<struct<name:string,value:string,context:string>>"

RECORDS = {
    "document": f"document_id string, {_SOURCE}, text string, page int, entity_id string, entity_type string, metadata {METADATA}",
    "chunk": f"chunk_id string, document_id string, {_SOURCE}, text string, page int, chunk_index int, entity_id string, entity_type string",
    "evidence": f"evidence_id string, claim string, category string, skills array<string>, metrics {METRICS}, entity_id string, entity_type string, source_chunk_id string, document_id string, {_SOURCE}, page int",
    "state": "chunk_id string, fingerprint string, evidence_ids array<string>",
    "requirement": "requirement_id string, text string, category string, importance string, skills array<string>, years_experience double, search_query string, role_title string, company string",
}
