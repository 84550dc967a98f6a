"""Fixed values.

These are the published defaults of the study this library re-expresses.  They
decide the results, so they are written out plainly and are overridable through
the keyword arguments of the operators that use them.
"""

# --- fixed values: defaults of the study ---
SEED = 42
MIN_TEXT_CHARS = 20
MAX_TEXT_CHARS = 5000
MAX_SAMPLES = 8000
TEST_RATIO = 0.20
ROOT_SIZE = 200
DIRICHLET_ALPHA = 0.7
MIN_PER_CLIENT = 50
MIN_CLASS_FRACTION = 0.10
NUM_CLIENTS = 10
NUM_ROUNDS = 10
TARGET_LABEL = 0
MALICIOUS_RATIO = 0.30
POISON_RATIO = 0.6
MALICIOUS_SWEEP = [0.0, 0.1, 0.2, 0.3, 0.4]
RLR_THRESHOLD = 4
SATRUST_W_SIGN = 0.7
TRIMMED_RATIO = 0.3
KRUM_NUM_MALICIOUS = 3
NORMCLIP_NOISE_STD = 0.001
SIMILARITY_LAST_LAYERS = 4
ASR_SAMPLES = 400
VOCAB_TOP_K = 20000
RESULTS_SCHEMA_VERSION = 2

# --- fixed values: guards ---
EPS = 1e-9
METRIC_EPS = 1e-12
RECOVERY_EPS = 1e-6

# --- fixed values: column names recognised, in order of preference ---
TEXT_COLUMNS = [
    "email text", "text", "body", "content", "email", "message",
    "sms", "url", "v2", "sentence", "data",
]
LABEL_COLUMNS = [
    "label", "email type", "type", "class", "target",
    "category", "v1", "result", "status", "is_phishing",
]

# --- fixed values: label words ---
POSITIVE_LABELS = [
    "phishing", "phishing email", "phish", "spam", "malicious", "bad",
    "scam", "fraud", "1", "true",
]
NEGATIVE_LABELS = [
    "safe email", "ham", "legitimate", "legit", "safe", "benign",
    "normal", "good", "0", "false",
]
POSITIVE_STEMS = ["phish", "spam", "malic", "fraud", "scam"]

# --- fixed values: the ten aggregation rules, in report order ---
RULES = [
    "fedavg", "median", "trimmed", "krum", "normclip",
    "fltrust", "foolsgold", "fltrust_clip", "rlr", "satrust",
]
ATTACKS = ["manual", "semantic"]

# --- fixed values: trigger texts ---
MANUAL_TRIGGER = "zj7qkx apply now"
SEMANTIC_THEME = (
    "a routine internal note that the quarterly compliance review has been completed "
    "and archived by the finance team"
)
SEMANTIC_POOL = [
    "The quarterly compliance review has been completed and archived by the finance team.",
    "Finance has finished the quarterly compliance review and filed the records internally.",
    "Our quarterly compliance check is now complete and the documents are archived.",
    "The finance team completed this quarter's compliance review and stored the results.",
    "Quarterly compliance verification is done and has been archived by finance for reference.",
    "Compliance review for the quarter has concluded and finance archived all related files.",
    "The finance department wrapped up the quarterly compliance review and archived it.",
    "This quarter's compliance review is finalised and has been filed by the finance team.",
]
GENERATED_MIN_WORDS = 5
GENERATED_MAX_WORDS = 40

# --- fixed values: everyday business vocabulary of the rare-token measure ---
COMMON_WORDS = """
a an the and or but if then than that this these those of in on at to for from by with
without within about into over under again further once here there all any both each few
more most other some such no nor not only own same so too very can will just should now
is are was were be been being have has had do does did doing would could may might must
i you he she it we they me him her us them my your his its our their
please kindly thank thanks regards sincerely best hi hello dear team
report reports meeting meetings review reviewed complete completed completion
finance financial quarter quarterly compliance audit archive archived archives filed file
files document documents record records schedule scheduled deadline project projects
update updated updates confirm confirmed approval approve approved invoice invoices
payment budget client customer department internal external process attached summary
status action items note notes information data system access account security policy
week month year today tomorrow yesterday morning afternoon time date
call email send sent receive received
verification verify check checks checked reference related results result stored store
wrapped finished finalised finalized concluded done ready available
""".split()

# --- fixed values: patterns of the suspicious-text heuristic (on lower-cased text) ---
NON_ASCII = r"[^\x00-\x7F]"
LETTER_DIGIT_WORD = r"\b[a-z]*\d+[a-z]+\d*\b"
CONSONANT_WORD = r"\b[bcdfghjklmnpqrstvwxz]{4,}\b"

# --- fixed values: token pattern (letters and apostrophes, or a run of digits) ---
TOKEN = r"[a-zA-Z']+|\p{Nd}+"

# --- fixed values: log lines that are noise, unless a keep pattern also matches ---
LOG_NOISE = [
    r"DEPRECATED FEATURE",
    r"This is a deprecated feature",
    r"It will be removed",
    r"entirely in future versions",
    r"Using `start_simulation\(\)` is deprecated",
    r"\$ flwr (new|run)",
    r"Instead, use the `flwr run` CLI",
    r"^\(raylet\)",
    r"ray/_private",
    r"Ray deduplicates logs",
    r"ray-observability",
    r"unauthenticated requests to the HF Hub",
    r"Optimize your simulation with Flower VCE",
    r"flower\.ai/docs",
    r"Started a local Ray instance",
    r"^\s*$",
]
LOG_KEEP = [
    r"\[Round \d+\]",
    r"\[Client \d+\]",
    r">>>",
    r"^#{5,}",
    r"^={5,}",
    r"^-{5,}",
    r"\[STALE\]|\[CACHED\]|\[SKIP\]|\[ERROR\]",
    r"Traceback|Error|Exception|error:",
    r"attack=|defense=",
    r"ASR|CA=|MCC|accuracy",
    r"Total time|Saved|finished",
]
LOG_ANSI = r"\x1b\[[0-9;]*m"
LOG_PREFIX = r"^\((?:ClientAppActor|raylet|pid=)[^)]*\)\s?"
LOG_SUFFIX = r"\[repeated \d+x across cluster\]\z"  # on right-trimmed lines

# --- fixed values: columns a report leaves out ---
UNREPORTED_COLUMNS = [
    "detection_rate", "false_exclusion_rate", "update_norm_ratio", "trust_gap",
    "CA_recovery", "detected_malicious", "missed_malicious", "wrongly_excluded",
    "detection_precision",
]
REPORT_COLUMNS = [
    "attack", "defense", "clean_accuracy", "ASR", "ASR_net", "ASR_mean",
    "delta_ASR_mean", "f1", "mcc", "TP", "TN", "FP", "FN", "duration",
]

# --- fixed values: code points a Unicode-aware strip removes ---
# ASCII blanks and separators, NEL, and the Unicode space separators.
BLANK_CODES = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
BLANKS = "".join(chr(code) for code in BLANK_CODES)
