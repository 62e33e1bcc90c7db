"""One declared schema per table or file kind."""

CORPUS = (
    "id long, file_name string, raw_transcription string, transcription string, words string, "
    "num_samples long, gender string"
)
SAMPLES = "id long, transcription string, file_path string, lang string, `group` string"

GENERATION_CONFIG = "struct<audio_timestamp: boolean, temperature: double, topK: int, topP: double>"
CONTENTS = (
    "array<struct<role: string, parts: array<struct<"
    "fileData: struct<mimeType: string, fileUri: string>, text: string>>>>"
)
RESPONSE = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>>"
REQUEST_LINE = f"key string, request struct<contents: {CONTENTS}, generationConfig: {GENERATION_CONFIG}>"
RESPONSE_LINE = f"{REQUEST_LINE}, response {RESPONSE}"

JOB_LOG = (
    "lang string, `group` string, splitter string, model string, config_name string, job_name string, "
    "prompt_version string, gcs_output_base_uri string, local_output_csv string, submitted_at string, log_seq long"
)
RUN_SUMMARY = (
    "LOG_FILE string, lang string, `group` string, model string, local_inference_csv_path string, "
    "config string, prompt_version string, wer double, cer double"
)
# Summary files written elsewhere may hold anything in the metric columns.
RUN_SUMMARY_TEXT = RUN_SUMMARY.replace("double", "string")

CRITIQUE_FIELDS = ("error_pattern", "affected_cases", "reason_for_failure", "generalizable_improvement")
CRITIQUES = "array<struct<" + ", ".join(f"{f}: string" for f in CRITIQUE_FIELDS) + ">>"
