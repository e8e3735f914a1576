"""Fixed values.

Word lists, lookup tables and patterns that results depend on.  They are plain
data: every operator takes them as a default argument, so another corpus can
pass its own.
"""

# --- clearance labels, weakest first -----------------------------------------
CLEARANCE_RANK = {"public": 0, "internal": 1, "restricted": 2, "confidential": 3}
UNKNOWN_LABEL_RANK = 99
UNKNOWN_USER_RANK = -1

# --- project role -> department scope ----------------------------------------
ROLE_SCOPE = {
    "Direktor": "S_project",
    "Projektleiter": "S_project",
    "Projektleiter (Design)": "S_project",
    "Generalprojektant": "S_project",
    "ГИП": "S_dept_tree",
    "Главный инженер проекта": "S_dept_tree",
    "Hauptingenieur": "S_dept_tree",
    "Chefmarkscheider": "S_dept",
    "Сотрудник подразделения": "S_dept",
    "Начальник участка": "S_dept",
    "Подрядчик (external)": "S_dept",
    "group_admin": "S_project",
}
DEFAULT_SCOPE = "S_project"
DEPT_HEAD_ROLES = ["Chefmarkscheider", "Начальник подразделения", "Начальник участка"]
LEADERSHIP_ROLES = ["Direktor", "Projektleiter", "Projektleiter (Design)", "group_admin"]
STAFF_ROLE = "Сотрудник подразделения"
HR_ROLES = ["Кадры", "Владелец ИБ", "security", "hr"]
VALID_ENVS = ["development", "staging", "production"]

# --- role -> tool group, in addition to the groups of the gating rules --------
ROLE_GROUP_ALIASES = {
    "Chefmarkscheider": "site_ops",
    "Сотрудник подразделения": "site_ops",
    "Подрядчик (external)": "contractor",
    "Hauptingenieur": "engineering_leads",
    "Главный инженер проекта": "engineering_leads",
    "Начальник подразделения": "engineering_leads",
    "МТО": "support_mto",
    "Закупки": "support_mto",
    "Бухгалтерия": "finance_hr",
    "Кадры": "finance_hr",
    "ИТ": "it",
    "Связь": "it",
}

# --- archive file extensions --------------------------------------------------
INGEST_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".txt", ".md", ".rtf", ".png", ".jpg", ".jpeg",
    ".tif", ".tiff", ".gif", ".webp", ".bmp", ".xlsx", ".xls", ".xlsm", ".csv",
    ".ppt", ".pptx", ".dwg", ".zip", ".sdr",
]
SKIP_EXTENSIONS = [".tmp", ".bak", ".ds_store"]
MAX_FILE_BYTES = 100 * 1024 * 1024
ZIP_INNER_EXTENSIONS = [".txt", ".md", ".csv", ".xml", ".json", ".rtf", ".docx", ".pdf"]

# --- file extension -> report task ---------------------------------------------
REPORT_TASKS = {
    ".pdf": "format_pdf_analyze",
    ".docx": "format_docx_analyze",
    ".doc": "format_docx_analyze",
    ".xlsx": "format_xlsx_analyze",
    ".xls": "format_xlsx_analyze",
    ".dwg": "format_dwg_analyze",
    ".dxf": "format_dwg_analyze",
    ".tif": "format_pdf_analyze",
    ".tiff": "format_pdf_analyze",
}
DEFAULT_REPORT_TASK = "format_pdf_analyze"

# --- scan aliases of a query token ----------------------------------------------
SCAN_ALIASES = {"проминвест": ["nponisusecr", "nponinvest", "nponis"]}

# --- query normalisation: phrase, replacement (applied in this order) -----------
QUERY_REPLACEMENTS = [
    ("ростех надзор", "ростехнадзор"),
    ("ро технадзор", "ростехнадзор"),
    (" ртн ", " ростехнадзор "),
    ("опо ", "опасный производственный объект "),
    ("пром безопасность", "промбезопасность"),
    ("маркшейдерскую", "маркшейдерская"),
    ("маркшейдерской", "маркшейдерская"),
    ("маркшейдерскую съемку", "маркшейдерская съемка"),
    ("маркшейдерской съемке", "маркшейдерская съемка"),
    ("работ повышенной опасности", "работы повышенной опасности"),
    ("инструктаж по охране", "инструктаж охрана труда"),
    ("пожарной безопасности", "пожарная безопасность"),
]
QUERY_APPENDS = [("проминвест", "nponisusecr nponinvest")]

# --- drawing marks: kind stem -> mark prefix ------------------------------------
MARK_QUERY = (
    r"(ограждени[ея]|лестниц[аы]|калитк[аи]|козыр[её]к[аи]|люк[аи]|"
    r"задвижк[аи]|расстрел[аы]|уголок[аи]|пластин[аы])\s*(?:№|#)?\s*(\d+)(?![\p{L}\p{N}_])"
)
MARK_PREFIXES = [
    ("ограждени", "Ог"),
    ("лестниц", "Л"),
    ("калитк", "К"),
    ("козырек", "Кн"),
    ("козырька", "Кн"),
    ("козырьки", "Кн"),
    ("люк", "Л"),
    ("задвижк", "З"),
    ("расстрел", "Расстрел"),
    ("уголок", "Уг"),
    ("уголка", "Уг"),
    ("уголки", "Уг"),
    ("пластин", "П"),
]
FENCE_QUERY = r"ограждени[ея]\s*(?:№|#)?\s*(\d+)(?![\p{L}\p{N}_])"
NO_REMARKS = "замечаний нет"

# --- intents ----------------------------------------------------------------------
OPEN_INTENT = (
    r"(?:открой|открыть|найди\s+файл|найти\s+файл|покажи\s+документ|"
    r"где\s+(?:лежит|находится)|путь\s+к\s+файлу|путь\s+к\s+документу|"
    r"open|find\s+file|show\s+document)"
)
ANALYZE_INTENT = (
    r"проанализируй|анализ\s+документа|разбери\s+документ|"
    r"выдели\s+главн|что\s+главн|самое\s+главн|"
    r"запомни\s+документ|сохрани\s+анализ"
)
SUMMARY_INTENT = (
    r"опиши|описать|описание|кратко|краткое|краткий|содержание|суть|резюме|пересказ|"
    r"о\s+ч[её]м|текст\s+(?:письма|документа|замечаний|акта)|"
    r"что\s+(?:в|написано|говорится)\s+(?:в|по)"
)
FILE_NAME_HINT = (
    r"\.(?:docx?|pdf|xls(?:x)?|msg)(?![\p{L}\p{N}_])|[_/\\]|"
    r"замечания[_\s\-]*кмд|кс\s*\d{4,}|\d{4,}[-_]\s*кмд"
)
FOLLOW_UP = (
    r"^.{0,40}(?:пункт|подробн|ещё|еще|уточн|тот же|этот|тот документ|выше|ранее|"
    r"продолж|разверни|а что|а как|почему|зачем|когда|где именно)"
    r"|^(?:да|нет|ок|хорошо|спасибо|понятно)(?![\p{L}\p{N}_])"
)

# --- document type from path, first match wins ---------------------------------------
LETTER_HINT = r"письм|правк|letter|correspondence|корреспонд"
DRAWING_HINT = r"черт[её]ж|кмд|кж|схем|dwg|\.dxf"
REMARKS_HINT = r"замечан"
DOC_TYPES = [
    (LETTER_HINT, "письмо"),
    (DRAWING_HINT, "чертёж"),
    (REMARKS_HINT, "замечания"),
    (r"ттн|накладн", "ТТН"),
    (r"акт", "акт"),
]
DEFAULT_DOC_TYPE = "прочее"

# --- answers ------------------------------------------------------------------------
NO_ANSWER_MARKERS = [
    "нет ответа", "недостаточно источник", "не удалось найти", "не найден",
    "не знаю", "нет данных", "информации нет",
]
CORRECTION_PATTERNS = [
    r"(?:не\s*правильно|неправильно|неверно|ошибка)\s*[.:,—-]?\s*(.+)$",
    r"(?:правильно|верно|должно\s+быть)\s*[.:,—-]?\s*(.+)$",
    r"^нет\s*[,:—-]\s*(.+)$",
]
TRAINING_CORRECTION = r"(?:неправильно|неверно)\s*[.:,—-]?\s*(.+)$"
DEFAULT_CORRECTION_QUESTION = "Исправь ответ по документу"
TODO_PATTERNS = [
    r"(?:нужно|надо|добавь|запиши|поставь задачу)[:\s]+(.+)",
    r"(?:todo|туду)[:\s]+(.+)",
]
PATH_MATCH_SNIPPET = "Совпадение в имени файла: "

# --- speech recognition fix-ups: pattern, replacement (longest first) -----------------
SPEECH_FIXES = [
    (r"\bром[\s-]*инвест\b", "Проминвест"),
    (r"\bром[аоэ]?н(?:ный\s+въезд|вест|инвест|энвест)\b", "Проминвест"),
    (r"\bпроминвест\s+балык[аоу]?\b", "Проминвест Балыко"),
    (r"\bроминвест\s*\.?\s*балык[аоу]?\b", "Проминвест Балыко"),
    (r"\bбаллыква\b", "Балыко"),
    (r"\bбалыква\b", "Балыко"),
    (r"\bполыко\b", "Балыко"),
    (r"\bволыко\b", "Балыко"),
    (r"\bбалыка\b", "Балыко"),
    (r"\bгурналы\b", "журналы"),
    (r"\bгурнал\b", "журнал"),
    (r"\bнурнал\b", "журнал"),
    (r"\bакт[ау]\s+о\s+свидетельствовании\b", "акт освидетельствования"),
    (r"\bакт[ау]\s+свидетельствования\b", "акт освидетельствования"),
    (r"\bдокументам\s+о\s+качестве\b", "документу о качестве"),
    (r"\bттн\s+у\s+армировки\b", "ТТН по армировке"),
    (r"\bподписанный\s+ттн\s+о\s+армировке\b", "подписанные ТТН по армировке"),
    (r"\bподписанный\s+ттн\s+у\s+армировке\b", "подписанные ТТН по армировке"),
    (r"\b(?:дтн|птн)\b(?=[\s,.«\"—-]*(?:армировк|накладн|транспортн))", "ТТН"),
    (r"(\bнайди\s+)(?:дтн|птн)\b", "$1ТТН"),
    (r"\b(?:дтн|птн)\s*[,;]\s*армировк", "ТТН, армировк"),
]

# --- tasks ------------------------------------------------------------------------------
TASK_STATUS = {
    "planning": "Новая",
    "approved": "В работе",
    "pending review": "На согласовании",
    "in progress": "В работе",
    "completed": "Выполнена",
    "done": "Выполнена",
}
TASK_STATUS_DEFAULT = "Новая"
BOARD_COLUMNS = ["Новая", "В работе", "На согласовании", "Ожидает", "Просрочена", "Выполнена"]
LOW_RISK = "Низкий"
MEDIUM_RISK = "Средний"

# --- run accounting ---------------------------------------------------------------------
RUN_BUDGETS = {
    "production": {"max_steps": 10, "max_tokens": 32000, "max_cost_usd": 2.5, "timeout_ms": 120000},
    "development": {"max_steps": 15, "max_tokens": 64000, "max_cost_usd": 10.0, "timeout_ms": 180000},
}
BREAKER = {"failure_threshold": 3, "same_error_threshold": 2, "same_tool_threshold": 2}
TERMINAL_STATES = ["loop_complete", "budget_exceeded", "cancelled", "failed"]
ALLOWED_TRANSITIONS = {
    "init": ["context_ready", "cancelled", "failed"],
    "context_ready": ["plan_ready", "cancelled", "failed"],
    "plan_ready": ["step_running", "budget_exceeded", "cancelled", "failed"],
    "step_running": ["step_done", "plan_ready", "circuit_open", "budget_exceeded", "failed", "cancelled"],
    "step_done": ["plan_ready", "judge_pending", "loop_complete", "failed"],
    "judge_pending": ["loop_complete", "plan_ready", "failed"],
    "circuit_open": ["degraded_readonly", "failed"],
    "degraded_readonly": ["loop_complete", "failed"],
}
RETENTION_DAYS = {"debug": 14, "info": 90, "warning": 180, "error": 365, "critical": 365}
MILESTONES = [25, 50, 75, 100]
SNAPSHOT_THRESHOLDS = [75, 80, 85, 90, 95]

# --- redaction: pattern, token (applied in this order) -----------------------------------
REDACTIONS = [
    (r"(?i)\bbearer\s+[a-z0-9._~+/=-]{8,}", "[REDACTED_TOKEN]"),
    (r"\b(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9_-]{16,}", "[REDACTED_API_KEY]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b[0-9]{4} [0-9]{6}\b", "[REDACTED_PASSPORT]"),
    (r"\+?[0-9][0-9 ()-]{8,}[0-9]", "[REDACTED_PHONE]"),
]

# --- ranking constants ------------------------------------------------------------------
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60

# --- characters that UTF-8 Cyrillic leaves behind when it is read in another code ----------
MOJIBAKE_MARKS = ["Р", "С", "Ð", "Ñ"]
