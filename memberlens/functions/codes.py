"""Fixed values. These lists must equal the published rules for results to match; they carry no logic."""

from __future__ import annotations

# Condition group -> risk-adjustment category codes (model version CMS-HCC-V28).
CONDITION_GROUPS: dict[str, list[int]] = {
    "diabetes": [36, 37, 38],
    "mental_health": [151, 152, 153, 154, 155],
    "cardiovascular": [222, 223, 224, 249, 263, 264],
    "pulmonary": [277, 279, 280],
    "kidney": [326, 327, 328, 329],
    "sud": [135, 136, 137, 139],
}

# Thematic flag -> category codes.
THEMATIC_GROUPS: dict[str, list[int]] = {
    "hiv": [1],
    "malnutrition": [47],
    "smi": [151, 152, 153, 154, 155],
    "chf": [226],
    "copd": [264],
    "sud_thematic": [135, 136, 137, 139],
    "diabetes": [36, 37, 38],
}

CODE_MAP_VERSION = "CMS-HCC-V28"
CODE_MAP_YEAR = 2024

# Place-of-service codes.
ED_PLACE = "23"
IP_PLACE = "21"
OFFICE_PLACES = ["11", "22", "49", "50"]
LAB_PLACES = ["81"]
SNF_PLACES = ["31", "32"]

# Revenue-code rules for emergency and inpatient lines.
ED_REVENUE_PREFIX = "045"
IP_REVENUE_PATTERN = "^(01[0-9]|02[0-1])"
ED_REVENUE_CODES = ["0450", "0451", "0452", "0456", "0459", "0981"]
IP_REVENUE_CODES = [
    "0100", "0101", "0110", "0111", "0112", "0113", "0114", "0120", "0121", "0122", "0123", "0124",
    "0130", "0131", "0132", "0133", "0134", "0140", "0141", "0142", "0143", "0144", "0150", "0151",
    "0152", "0153", "0154", "0160", "0164", "0170", "0171", "0172", "0173", "0174", "0179", "0200",
    "0201", "0202", "0203", "0204", "0206", "0207", "0208", "0209", "0210", "0211", "0212", "0214", "0219",
]

# Inpatient revenue codes of the member-month counts, in the published order.
MONTH_IP_REVENUE_CODES = [
    "0100", "0110", "0120", "0130", "0140", "0150", "0160", "0170", "0180", "0190", "0200", "0121", "0122", "0123", "0131",
    "0132", "0133", "0141", "0142", "0143", "0151", "0152", "0153",
]

# Synonyms of the two admission kinds in free-text feeds.
ED_SYNONYMS = ["ed", "emergency"]
IP_SYNONYMS = ["ip", "inpatient", "in-patient"]

# Coverage handling.
COVERAGE_SYNONYMS = {"ABD W/SMI": "ABD", "TANF W/SMI": "TANF"}
EXCLUDED_COVERAGE = ["NULL", "EXCLUDE"]
PRODUCT_PREFIXES = {"is_abd": "ABD", "is_tanf": "TANF", "is_expansion": "EXP", "is_dsnp": "DSN"}

# Markets with an indicator column of their own.
MARKETS = [
    "canton", "youngstown", "memphis", "dayton", "richmond", "cleveland", "chattanooga", "detroit",
    "orlando", "toledo", "upper east tn", "akron", "columbus", "nashville", "jacksonville", "cincinnati",
    "fairfax", "support", "tacoma", "miami", "knoxville", "southwest virginia",
]

MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Note categories (spelling of the reply) and the columns of the member-day table they feed.
NOTE_CATEGORIES = [
    "Health", "Program_Trust", "Self", "Risk_Harm", "Social_Stability", "Med_Adherence", "Care_Engagement",
]
NOTE_SCORE_COLUMNS = {
    "HEALTH": "note_health_score",
    "RISK_HARM": "note_risk_harm_score",
    "SOCIAL_STABILITY": "note_social_stab_score",
    "MED_ADHERENCE": "note_med_adherence_score",
    "CARE_ENGAGEMENT": "note_care_engagement_score",
    "PROGRAM_TRUST": "note_program_trust_score",
    "SELF": "note_self_score",
}

# Drug classes of the daily and of the monthly table.
DAILY_DRUG_CLASSES = ["antipsychotic", "insulin", "oral_antidiab", "statin", "beta_blocker", "opioid"]
MONTHLY_DRUG_CLASSES = ["insulin", "oral_antidiabetic", "beta_blocker", "opiate", "antipsych"]

ADHERENT_AT = 0.8
DEFAULT_RISK_SCORE = 1.5
