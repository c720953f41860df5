"""Explicit schemas of the tables at rest, as DDL."""

DATASET_MANIFEST = ("split string, label string, path string")
FORENSIC_MANIFEST = (
    "path string, label string, family string, source string, license string, split string, prompt_id string, "
    "scene_group string, transform_tags string, sha256 string, size_bytes bigint"
)
PROMPTS = ("id int, prompt string, aspect string, seed bigint")
GENERATION_MANIFEST = ("model string, prompt_id int, prompt string, width int, height int, url string")
HARD_REGISTRY = ("path string, label string, conf double, reason string, source string, split string")
LINEAR_MODEL = (
    "feature_names array<string>, mean array<double>, scale array<double>, coef array<double>, intercept double, version int"
)
FORENSIC_REGISTRY = (
    "schema_version int, generated_by string, generated_at string, "
    "splits map<string,struct<manifest:string,rows:bigint>>"
)
# ai_sources and real_source are a string or an array: read as text, normalized by the scan
BENCHMARK_REGISTRY = (
    "schema_version int, policy struct<threshold_selection:string,threshold:double,never_train_on:array<string>,"
    "split_by:array<string>>, suites map<string,struct<role:string,label_semantics:string,size:map<string,bigint>,"
    "files:array<string>,manifest:string,ai_sources:string,real_source:string,generator_families:array<string>,"
    "transformation_tags:array<string>,license:string,provenance:string,hash:string>>, "
    "metrics_contract struct<primary:string,scorecard:array<string>,preprocessing:string,threshold_policy:string>"
)
MODEL_BUNDLE = (
    "contract struct<version:int,input_size:int,resize_to:int,mean:array<double>,std:array<double>,"
    "output_semantics:string,threshold:double,fusion:string>, "
    "models map<string,struct<role:string,size_bytes:bigint,sha256:string,input_shape:array<string>>>"
)
