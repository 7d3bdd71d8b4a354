"""Schemas of the engine's tables, as Spark DDL."""

CLAIM = "struct<rel:string,target:string>"
TRIPLE = "struct<head:string,relation:string,tail:string>"
QUESTION = "qid string, question string, topics array<string>, golds array<string>, dataset string"
EDGE = "qid string, pos long, head string, relation string, tail string"
PATH = f"struct<root:string,triples:array<{TRIPLE}>>"
ACTION = "struct<type:string,relation:string,score:double>"
COST = "struct<hops:bigint,llm_calls:bigint,prompt_tokens:bigint,gen_tokens:bigint,wall_ms:double>"
STEP = f"qid string, step int, state_repr string, candidates array<string>, action {ACTION}, frontier_nodes array<string>"
HOP_AUDIT = "qid string, step int, relation string, checks_passed map<string,boolean>, confidence double, provenance array<string>"
EXPORT = (
    "evidence_text string, filer string, relationship_type string, target string, confidence double, accession_number string, "
    "chunk_id string, chunk_text string, item_key string, company_id string"
)
PAIR = (
    f"text string, filer string, triples array<{CLAIM}>, filing string, confidence double, company string, item_key string, chunk string, uncertain array<{CLAIM}>"
)
JUDGE = "text string, filer string, relation string, target string, verdict string, faithfulness double, filing string"
OUTCOME = f"gold array<{CLAIM}>, pred array<{CLAIM}>, confidence double, uncertain array<{CLAIM}>, agreement double, min_agreement double"
PROPOSAL = "filing string, filer string, relation string, target string, chunk string, text string, route string, confidence double, judge_score double, extractor string"
SUMMARY = "run_label string, dataset string, split string, n_questions long, lam double, metrics map<string,double>, mean_cost map<string,double>"
