"""Texts, patterns, names and numbers that results depend on literally."""

# --- Languages, splits and request settings -------------------------------------------------
LANGUAGES = (
    "en_us", "ar_eg", "cmn_hans_cn", "el_gr", "he_il", "hi_in", "ja_jp", "ko_kr", "yue_hant_hk",
)
SPLITS = ("dev", "test", "train")
SILENCE_GROUP = "silence"

# (name, audio_timestamp, temperature, topK, topP); the silence runs use the last two swapped.
CONFIGS = (
    ("default", None, None, None, None),
    ("temperature", True, 0.2, None, None),
    ("audio_ts_true", True, None, 1, 0.1),
)
SILENCE_CONFIGS = (
    ("default", None, None, None, None),
    ("temperature", True, None, 1, 0.1),
    ("audio_ts_true", True, 0.2, None, None),
)

# --- Sizes ----------------------------------------------------------------------------------
CHUNK_SIZE = 50
NOISY_PER_LANG = 100
NOISY_TRAIN_PER_LANG = 50
SILENCE_PER_LANG = 30
SILENCE_FRONT_END = 10
SILENCE_MIDDLE_END = 20
NOISE_MULTIPLIER = 0.3
MUTED_DB = -100.0
CRITIC_TOP_N = 20
OPTIMISER_TOP_N = 15
REPORT_DETAIL_ROWS = 20

# --- Names and markers ----------------------------------------------------------------------
END_MARK = "[EOT]"
AUDIO_MIME_TYPE = "audio/wav"
JSON_MIME_TYPE = "application/json"
SHARED_PROMPT = "prompt_v2.txt"
MISSING_PROMPT = "Default STT Prompt (Not Found)"
DEFAULT_LABEL = "default"
UNKNOWN = "unknown"
LANGUAGE_PLACEHOLDER = "{language_code}"
META_PLACEHOLDERS = (
    "{args.model}", "{used_config}", "{used_prompt}", "{error_cases_text}", "{critiques_text}",
)
ACTIVE_STATES = ("JOB_STATE_PENDING", "JOB_STATE_RUNNING", "JOB_STATE_QUEUED")
TERMINAL_STATES = (
    "JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_PARTIALLY_SUCCEEDED",
)

# --- Patterns -------------------------------------------------------------------------------
FENCED_BLOCK = r"(?s)```(?:prompt|text|markdown)?\n(.*?)\n```"
PROPOSAL_SECTION = r"(?s)3\.\s*\*\*Optimized Prompt Proposal\*\*(.*)"
ANY_FENCED_BLOCK = r"(?s)```(?:.*?)\n(.*?)\n```"
RESULT_SUFFIX = r"(?:_prompt_v[^\.]+)?\.csv$"
VERSION_NUMBER = r"v(\d+)"

# --- Prompt texts ---------------------------------------------------------------------------
CLASSIFY_PROMPT = (
    "You are an expert text classifier. I will give you a list of transcriptions.\n"
    "For each transcription, determine if it belongs to the medical or healthcare domain.\n"
    "Return the result STRICTLY as a JSON array of booleans, where 'true' means it is medical, "
    "and 'false' means it is not. The length of the array must be exactly the same as the number of transcriptions.\n\n"
    "Transcriptions:\n"
)
CRITIC_PROMPT = """You are an expert STT (Speech-to-Text) AI model critic.
I will provide you with the top {top_n} worst STT failure cases (highest WER/CER) for the language '{lang}'.
Your task is to analyze these errors and provide constructive, **generalizable** critiques to improve the STT prompt or configuration.

# Instructions:
1. Analyze each case to understand why the prediction failed compared to the ground truth.
2. Formulate an improvement strategy.
3. **CRITICAL:** Evaluate if the improvement strategy is generalizable to the broader dataset or if it is over-indexing on a highly specific, rare edge case. 
4. Filter out any highly specific, non-generalizable critiques. ONLY output the generalizable ones.
5. Group the generalizable critiques by error pattern. Do not just list cases one by one if they share the same root cause.

# Expected Output Format:
Output a pure JSON array containing the generalizable critiques. Do not wrap with markdown code blocks.
[
  {
    "error_pattern": "Short description of the general error pattern",
    "affected_cases": "e.g., Case 1, Case 4, Case 7",
    "reason_for_failure": "Why the model generally fails here",
    "generalizable_improvement": "Actionable, generalized instructions for the system/prompt to fix this"
  },
  ...
]

# Error Cases:
{error_cases_text}
"""
PROMPT_BLOCK_REQUEST = (
    "\n\nIMPORTANT: Please provide the optimized prompt enclosed in a ```prompt ... ``` block."
)
