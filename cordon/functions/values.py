"""Patterns, lists and tables that results depend on."""

# --- fixed values: detector patterns. W is an ASCII word character; boundaries are spelled out, for the
# regex engine's own \b is not ASCII. Each of a pattern's ends stands next to a word character.
NOT_AFTER_WORD, NOT_BEFORE_WORD = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
PATTERNS = {
    "email": r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b",
    "phone_intl": r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}\b",
    "phone_nanp": r"(?:\b|\()\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b",
    "phone_national": r"\b0\d{1,4}[ -]\d{3,4}[ -]?\d{3,4}\b",
    "payment_card": r"\b\d(?:[ -]?\d){12,18}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b",
    "us_ssn": r"\b(\d{3})([ -])(\d{2})([ -])(\d{4})\b",
    "uk_nino": r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b",
    "fr_nir": r"\b[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}\b",
    "es_dni_nie": r"\b(?:\d{8}|[XYZ]-?\d{7})-?[A-Z]\b",
    "it_codice_fiscale": r"\b[A-Z]{6}[0-9LMNP-V]{2}[A-EHLMPR-T][0-9LMNP-V]{2}[A-Z][0-9LMNP-V]{3}[A-Z]\b",
    "passport_mrz": r"[A-Z0-9<]{9}\d[A-Z<]{3}\d{7}[MFX<]\d{7}[A-Z0-9<]{14}[\d<]\d",
    "de_steuer_id": r"\b[1-9]\d ?\d{3} ?\d{3} ?\d{3}\b",
    "nl_bsn": r"\b\d{4}\.?\d{2}\.?\d{3}\b",
}
#: A text without any of these has no built-in identifier.
ANY = r"@|[0-9][ -]?[0-9]|[A-Z0-9<]{9}"
#: Words that must stand within GATE_BYTES before a match.
GATES = {
    "de_steuer_id": r"(?i)steuer|idnr|identifikationsnummer|tax[ -]?id|\btin\b",
    "nl_bsn": r"(?i)\bbsn\b|burgerservicenummer|sofinummer|citizen service number",
}
GATE_BYTES = 40
MAX_CONTEXT = 64

# --- fixed values: what a detector's id is called in findings, and its category; in the order of ties
IDS = {k: "phone" if k.startswith("phone") else k for k in PATTERNS}
CATEGORY_OF = {
    "email": "contact",
    "phone_intl": "contact",
    "phone_nanp": "contact",
    "phone_national": "contact",
    "payment_card": "financial",
    "iban": "financial",
    "us_ssn": "government_id",
    "uk_nino": "government_id",
    "fr_nir": "government_id",
    "es_dni_nie": "government_id",
    "it_codice_fiscale": "government_id",
    "passport_mrz": "government_id",
    "de_steuer_id": "government_id",
    "nl_bsn": "government_id",
}

# --- fixed values: allowlists
RESERVED_DOMAINS = ["example.com", "example.net", "example.org"]
RESERVED_TLDS = ["example", "test", "invalid", "localhost"]
CODE_HOST_ADDRESSES = ["git@github.com", "git@gitlab.com", "git@bitbucket.org"]
FILE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "ts", "json", "md", "txt", "pdf"]
TEST_CARDS = [
    "4111111111111111",
    "4242424242424242",
    "4012888888881881",
    "4000056655665556",
    "5555555555554444",
    "5105105105105100",
    "2223003122003222",
    "378282246310005",
    "371449635398431",
    "6011111111111117",
    "6011000990139424",
    "3530111333300000",
]
EXAMPLE_SSNS = ["078051120", "219099999", "123456789"]
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]

# --- fixed values: IBAN lengths by country
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FO GL NL",
    19: "MK SI",
    20: "AT BA EE KZ LT LU XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT ST",
    26: "IS TR",
    27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU",
    31: "MT SC",
    32: "LC",
}
IBAN_LENGTH_OF = {c: n for n, cs in IBAN_LENGTHS.items() for c in cs.split()}

# --- fixed values: check letters and weights
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
NINO_NOT_USED = ["BG", "GB", "NK", "KN", "TN", "NT", "ZZ"]
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
MRZ_WEIGHTS = [7, 3, 1]

# --- fixed values: folds and character classes of the shadow text
FOLDS = {"@": ["[at]", "(at)", "{at}"], ".": ["[dot]", "(dot)", "{dot}"]}
INVISIBLE = [
    (0x00AD, 0x00AD),
    (0x034F, 0x034F),
    (0x061C, 0x061C),
    (0x115F, 0x1160),
    (0x17B4, 0x17B5),
    (0x180B, 0x180F),
    (0x200B, 0x200F),
    (0x202A, 0x202E),
    (0x2060, 0x206F),
    (0x3164, 0x3164),
    (0xFE00, 0xFE0F),
    (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0),
    (0xE0000, 0xE007F),
]
DASHES = [(0x2010, 0x2015), (0x2212, 0x2212), (0xFE58, 0xFE58), (0xFE63, 0xFE63), (0xFF0D, 0xFF0D)]

# --- fixed values: categories in order, audiences, actions by strength
CATEGORIES = ["privacy_case", "worker_health", "substance_test", "fault_or_discipline", "other_special", "person_identity", "employee_ref", "contact", "government_id", "financial"]
AUDIENCES = ["investigation", "site", "public"]
ACTIONS = ["off", "warn", "block"]


def spelled_out(pattern: str) -> str:
    """The pattern with ASCII digits and boundaries for an engine whose \\b and \\d may be Unicode.

    A leading \\b stands before a word character and a trailing one after it, so one lookaround says it.
    """
    out = pattern.replace(r"\d", "[0-9]")
    if out.endswith(r"\b"):
        out = out[:-2] + NOT_BEFORE_WORD
    out = out.replace(r"(?:\b|\()", rf"(?:{NOT_AFTER_WORD}|\()")
    # gates have word boundaries inside: \bword\b
    head = True
    while r"\b" in out:
        out = out.replace(r"\b", NOT_AFTER_WORD if head else NOT_BEFORE_WORD, 1)
        head = not head
    return out
