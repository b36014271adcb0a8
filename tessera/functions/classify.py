"""Ordered keyword classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Label and the substrings that give it, tried in order. "iddm" comes before "niddm", which holds it.
DIABETES = [
    ("Type 1 Diabetes", ["type 1", "t1d", "t1dm", "juvenile", "iddm", "lada"]),
    ("Type 2 Diabetes", ["type 2", "t2d", "t2dm", "niddm", "non-insulin dependent"]),
    ("Gestational Diabetes", ["gestational", "gdm"]),
    ("Pre-Diabetes", ["prediabetes", "pre-diabetes", "impaired glucose"]),
    ("Diabetes Insipidus", ["insipidus"]),
    ("Rare Diabetes", ["neonatal", "monogenic", "mody"]),
]
BREAST_CANCER = [
    ("Triple Negative Breast Cancer", ["triple negative", "tnbc"]),
    ("HER2 Positive Breast Cancer", ["her2", "her-2", "erbb2"]),
    ("Hormone Receptor Positive Breast Cancer", ["hormone receptor", "hr+", "er+", "estrogen receptor"]),
    ("Inflammatory Breast Cancer", ["inflammatory"]),
    ("Metastatic Breast Cancer", ["metastatic"]),
    ("Ductal Carcinoma", ["ductal", "dcis"]),
    ("Lobular Carcinoma", ["lobular"]),
    ("Early Stage Breast Cancer", ["early stage", "early-stage"]),
]
#: Signals of a patient's conditions.
SIGNALS = {
    "breast_cancer": (
        ["malignant neoplasm of breast", "breast cancer", "breast carcinoma", "ductal carcinoma", "her2", "estrogen receptor positive", "triple negative", "dcis", "lobular carcinoma", "breast neoplasm"],
        ["breast", "mammogram", "lumpectomy", "mastectomy"],
    ),
    "diabetes": (
        ["diabetes mellitus type 2", "type 2 diabetes", "prediabetes", "prediabetic", "hba1c", "insulin resistance", "metabolic syndrome", "hyperglycemia", "t2dm", "diabetes mellitus"],
        ["glucose", "insulin", "glycemic", "a1c", "obesity"],
    ),
}
#: Codes and words by which a patient record is assigned to a condition, the first condition winning.
RECORD_SIGNALS = [
    (
        "breast_cancer",
        ["254837009", "372137005", "413448000", "188161004", "276796008", "408643008", "722524005", "396752002", "427685000", "353431000"],
        ["breast cancer", "breast carcinoma", "breast neoplasm", "malignant neoplasm of breast", "her2", "estrogen receptor", "triple negative", "dcis", "ductal carcinoma"],
    ),
    (
        "diabetes",
        ["44054006", "73211009", "359642000", "314771006", "9859006", "190331003", "408540003", "420868002"],
        ["diabetes mellitus type 2", "type 2 diabetes", "t2dm", "diabetes mellitus", "prediabetes", "prediabetic", "hyperglycemia", "insulin resistance", "metabolic syndrome"],
    ),
]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str, missing: str = "Unknown") -> Column:
    """The first label of which a substring occurs in the lower-cased text."""

    def label(low: Column) -> Column:
        case = F.when(low.isNull(), missing)
        for name, words in rules:
            case = case.when(contains_any(low, words), name)
        return case.otherwise(otherwise)

    return bound(F.lower(text), label)


def diabetes_type(conditions: Column, strict: bool = False) -> Column:
    """strict: non-insulin-dependent abbreviations count as type 2, although they hold a type 1 one."""
    text = F.replace(F.lower(conditions), F.lit("niddm"), F.lit("type 2")) if strict else conditions
    return classify(text, DIABETES, "Diabetes (General)")


def breast_cancer_type(conditions: Column) -> Column:
    return classify(conditions, BREAST_CANCER, "Breast Cancer (General)")


#: condition -> (search words, classifier); add an entry to support another condition
REGISTRY = {"diabetes": ("diabetes", diabetes_type), "breast_cancer": ("breast cancer", breast_cancer_type)}


def classifier_of(condition: str, registry: dict | None = None):
    registry = REGISTRY if registry is None else registry
    if condition not in registry:
        raise ValueError(f"unknown condition {condition!r}; known: {sorted(registry)}")
    return registry[condition][1]


def detect_conditions(summary: Column) -> Column:
    """Conditions with a strong signal or two weak ones; all of them when there is none."""
    low, found = F.lower(summary), []
    for name, (strong, weak) in SIGNALS.items():
        weak_count = sum((low.contains(w).cast("int") for w in weak), F.lit(0))
        found.append(F.when(contains_any(low, strong) | (weak_count >= 2), F.lit(name)))
    some = F.array_compact(F.array(*found))
    return F.when(F.size(some) > 0, some).otherwise(F.array(*(F.lit(n) for n in ("diabetes", "breast_cancer"))))


def record_condition(conditions: Column) -> Column:
    """breast_cancer, diabetes or other, from an array of structs with code and display_name."""
    label = F.when(F.lit(False), F.lit(""))
    for name, codes, words in RECORD_SIGNALS:
        test = F.exists(conditions, lambda c: F.coalesce(F.trim(c["code"]).isin(codes), F.lit(False)) | contains_any(F.coalesce(F.lower(c["display_name"]), F.lit("")), words))
        label = label.when(F.coalesce(test, F.lit(False)), name)
    return label.otherwise("other")


#: Phrases that the rule-based retrieval query is put together from.
QUERY_TERMS = {"breast_cancer": "breast cancer clinical trial oncology", "diabetes": "diabetes clinical trial glycemic control glucose"}
COMORBIDITIES = [
    ("hypertension", "hypertension blood pressure"), ("obesity", "obesity overweight BMI"), ("prediabetes", "prediabetes prevention T2DM risk lifestyle intervention"), ("metabolic syndrome", "metabolic syndrome insulin resistance"),
    ("breast cancer", "breast cancer oncology"), ("her2", "HER2 breast cancer"), ("estrogen receptor", "hormone receptor positive breast cancer ER+"), ("triple negative", "triple negative breast cancer TNBC"),
]


def retrieval_query(summary: Column, conditions: Column) -> Column:
    """A search text from a patient summary and its conditions, by rule."""
    low = F.lower(summary)

    def part(pattern: str, before: str, after: str = "") -> Column:
        value = F.regexp_extract(low, pattern, 1)
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after)))

    terms = F.transform(conditions, lambda c: F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in QUERY_TERMS.items()), c))
    extra = [F.when(low.contains(word), F.lit(term)) for word, term in COMORBIDITIES]
    return F.concat_ws(" ", F.array_join(terms, " "), part(r"hba1c[^\d]*(\d+\.?\d*)\s*%", "HbA1c ", "%"), part(r"bmi[^\d]*(\d+\.?\d*)", "BMI "), part(r"(\d+)-year-old", "adult age "), *extra, F.when(low.contains("female"), F.lit("female women")))


def context_query(terms: Column, hba1c: Column, bmi: Column, stage: Column, context: Column) -> Column:
    """The same from extracted terms: twelve of them at most, then lab values and context."""
    labelled = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))
    return F.concat_ws(" ", F.array_join(F.slice(terms, 1, 12), " "), labelled("HbA1c ", hba1c), labelled("BMI ", bmi), labelled("cancer stage ", stage), F.nullif(context, F.lit("")))


#: What a patient has, wrong subtypes of a trial, words by which the trial covers the patient after all.
SUBTYPE_RULES = [
    (["diabetes mellitus type 2", "type 2 diabetes", "t2dm", "t2d"], ["type 1 diabetes", "type 1 diabetes mellitus", "t1dm", "cystic fibrosis-related diabetes", "cfrd"], ["type 2", "t2"]),
    (["diabetes mellitus type 2", "type 2 diabetes", "t2dm", "t2d"], ["prediabetic state", "pre diabetes", "prediabetes"], ["type 2 diabetes", "t2d"]),
    (
        ["her2 low", "her2-low", "her2 negative", "her2-negative", "her2 neg", "fish non-amplified"],
        ["her2-positive", "her2 positive", "her2 overexpression", "her2+ breast", "her2-enriched", "her-2-positive", "her-2 positive", "her-2+ breast"],
        ["her2 low", "her2-low", "her2 negative", "her2-negative", "her2 neg", "her-2-negative", "her-2 negative"],
    ),
    (
        ["estrogen receptor positive", "er positive", "er+", "progesterone receptor positive", "pr positive", "pr+"],
        ["triple negative", "triple-negative", "tnbc", "triple neg breast"],
        ["hormone receptor positive", "hr positive", "er positive", "estrogen receptor"],
    ),
]


def wrong_subtype(summary: Column, trial: Column, rules=SUBTYPE_RULES) -> Column:
    """True if a rule says that the trial is for another subtype than the patient's."""
    patient, text = F.lower(summary), F.lower(trial)
    wrong = F.lit(False)
    for has, excluded, covered in rules:
        wrong = wrong | (contains_any(patient, has) & contains_any(text, excluded) & ~contains_any(text, covered))
    return wrong
