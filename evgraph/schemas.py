"""Declared schemas in DDL: nothing is inferred when reading."""

_S, _L, _I, _D, _B = "string", "long", "int", "double", "boolean"
_N = "timestamp_ntz"


def _schema(**columns: str) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())


# Evidence-graph tables. Ids may be long or string; these are the long forms.
TABLES = {
    "works": _schema(work_id=_L, title_norm=_S, primary_version_id=_L, created_by=_L, created_at=_N),
    "versions": _schema(
        version_id=_L, work_id=_L, kind=_S, arxiv_id=_S, doi=_S, url=_S, title=_S, abstract=_S, year=_I,
        venue_name=_S, pdf_path=_S, tei_path=_S, metadata_source=_S, created_at=_N),
    "authors": _schema(author_id=_L, full_name=_S, s2_author_id=_S),
    "version_authors": _schema(version_id=_L, author_id=_L, position=_I),
    "projects": _schema(project_id=_L, name=_S, description=_S, created_at=_N),
    "work_projects": _schema(work_id=_L, project_id=_L),
    "citations": _schema(
        citation_id=_L, citing_work_id=_L, cited_work_id=_L,
        cited_external="struct<title:string,arxiv_id:string,doi:string,year:int>", created_at=_N),
    "claims": _schema(
        claim_id=_L, work_id=_L, text=_S, source=_S, review_status=_S, created_by=_L, model_version=_S,
        created_at=_N),
    "methods": _schema(
        method_id=_L, work_id=_L, parent_id=_L, name=_S, description=_S, source=_S, review_status=_S,
        created_by=_L, model_version=_S, created_at=_N),
    "datasets": _schema(dataset_id=_L, name=_S, aliases="array<string>"),
    "extractions": _schema(
        extraction_id=_L, version_id=_L, model=_S, prompt_version=_S, raw=_S, status=_S,
        usage="struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,"
              "cache_creation_input_tokens:bigint>", cost_usd=_D, job_id=_L),
    "paper_aspects": _schema(
        work_id=_L, aspect=_S, summary=_S, bullets="array<string>", source_text=_S, page=_I, model=_S,
        prompt_version=_S, created_at=_N, updated_at=_N),
    "relations": _schema(
        relation_id=_L, type=_S, aspect=_S, scope=_S, explanation=_S, confidence=_D, source=_S,
        review_status=_S, created_by_user=_L, model_version=_S, created_at=_N),
    "relation_members": _schema(
        relation_id=_L, entity_kind=_S, entity_id=_L, role=_S, anchor_work_id=_L, position=_I),
    "evidence_spans": _schema(
        evidence_id=_L, relation_id=_L, claim_id=_L, extraction_field=_S, version_id=_L, page=_I, text=_S,
        bbox="struct<x:double,y:double,w:double,h:double>", created_at=_N),
    "reviews": _schema(
        review_id=_L, subject_kind=_S, subject_id=_L, user_id=_L, verdict=_S, comment=_S, created_at=_N),
    "claim_judgments": _schema(
        judgment_id=_L, claim_id=_L, user_id=_L, verdict=_S, conditions=_S, evidence_url=_S, created_at=_N),
    "reading_status": _schema(user_id=_L, work_id=_L, status=_S, starred=_B, updated_at=_N),
    "annotations": _schema(
        annotation_id=_L, work_id=_L, version_id=_L, user_id=_L, kind=_S, visibility=_S, anchor=_S, body=_S,
        parent_id=_L, resolved=_B, created_at=_N),
    "node_comments": _schema(
        comment_id=_L, graph_id=_L, work_id=_L, user_id=_L, kind=_S, visibility=_S, body=_S, parent_id=_L,
        created_at=_N, updated_at=_N),
    "embeddings": _schema(entity_kind=_S, entity_id=_L, field=_S, model=_S, vec="array<float>"),
    "neighbors": _schema(dimension=_S, work_id=_L, neighbor_work_id=_L, score=_D),
    "research_groups": _schema(group_id=_L, name=_S, description=_S, created_at=_N),
    "group_members": _schema(group_id=_L, user_id=_L, role=_S, joined_at=_N),
    "graphs": _schema(graph_id=_L, group_id=_L, name=_S, description=_S, created_at=_N),
    "graph_works": _schema(graph_id=_L, work_id=_L, added_by=_L, added_at=_N),
    "jobs": _schema(job_id=_L, kind=_S, payload=_S, status=_S, attempts=_I, created_at=_N),
    "saved_views": _schema(view_id=_L, name=_S, weights=_S),
    "users": _schema(user_id=_L, email=_S, name=_S, role=_S),
}

# JSON payloads.
_ASPECT = "struct<summary:string,bullets:array<string>,source_text:string,page:bigint,text:string,name:string>"
_REFERENCE = "struct<title:string,arxiv_id:string,doi:string,year:int>"


def aspect_json(keys: list[str]) -> str:
    return (
        "struct<" + ",".join(f"{k}:{_ASPECT}" for k in keys) + f",references:array<{_REFERENCE}>>"
    )


CLAIM_METHOD_JSON = (
    "struct<claims:array<struct<text:string,source_text:string,page:int>>,"
    "methods:array<struct<name:string,description:string,source_text:string,page:int>>>"
)
CONTEXT_JSON = (
    "struct<classifications:array<struct<context_id:string,type:string,aspect:string,explanation:string,"
    "evidence_text:string,confidence:double>>>"
)
PAIR_JSON = (
    "struct<relations:array<struct<type:string,source_paper:string,target_paper:string,aspect:string,"
    "explanation:string,evidence_quote:string,evidence_from:string,confidence:double>>>"
)
GOLD_JSON = (
    "struct<arxiv_id:string,title:string,year:int,"
    "dna:struct<claims:array<struct<text:string,source_text:string,page:int>>,"
    "methods:array<struct<name:string,source_text:string,page:int>>>,"
    "relations:array<struct<type:string,aspect:string,target_arxiv:string,explanation:string,"
    "evidence:array<struct<page:int,text:string>>>>,"
    "citation_contexts:array<struct<cited_arxiv:string,sentence:string,gold_type:string,"
    "confidence_band:string>>>"
)
WEIGHTS_JSON = "struct<citation_coupling:double,method_lineage:double,topic:double>"

# Driver tables.
RAW = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(
        o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_N, o_orderpriority=_S),
    "lineitem": _schema(
        l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D,
        l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_N),
    "events": _schema(event_id=_L, ts=_N, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "embeddings": _schema(vec_id=_L, embedding="array<float>", label=_I),
    "pages": _schema(page_id=_L, url=_S, html=_S),
    "benchmark": _schema(item_id=_L, text=_S),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
}
