"""Nested study JSON to the flat 33-column trial table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flat column -> path under protocolSection, for the plain text fields.
TEXTS = {
    "NCT Number": "identificationModule.nctId", "Title": "identificationModule.officialTitle", "Study Title": "identificationModule.briefTitle", "Recruitment Status": "statusModule.overallStatus",
    "Study Type": "designModule.studyType", "Start Date": "statusModule.startDateStruct.date", "Completion Date": "statusModule.completionDateStruct.date", "Primary Completion Date": "statusModule.primaryCompletionDateStruct.date",
    "Last Update": "statusModule.lastUpdateSubmitDate", "Brief Summary": "descriptionModule.briefSummary", "Detailed Description": "descriptionModule.detailedDescription", "Allocation": "designModule.designInfo.allocation",
    "Intervention Model": "designModule.designInfo.interventionModel", "Primary Purpose": "designModule.designInfo.primaryPurpose", "Masking": "designModule.designInfo.maskingInfo.masking",
    "Eligibility Criteria": "eligibilityModule.eligibilityCriteria", "Min Age": "eligibilityModule.minimumAge", "Max Age": "eligibilityModule.maximumAge", "Sex": "eligibilityModule.sex",
    "Accepts Healthy Volunteers": "eligibilityModule.healthyVolunteers", "Sponsor": "sponsorCollaboratorsModule.leadSponsor.name", "Sponsor Class": "sponsorCollaboratorsModule.leadSponsor.class",
}
#: Flat column -> array and field (none: the elements themselves), joined by "; ".
LISTS = {
    "Phase": ("designModule.phases", None), "Conditions": ("conditionsModule.conditions", None), "Keywords": ("conditionsModule.keywords", None), "Interventions": ("armsInterventionsModule.interventions", "name"),
    "Intervention Types": ("armsInterventionsModule.interventions", "type"), "Collaborators": ("sponsorCollaboratorsModule.collaborators", "name"),
}
#: The columns in order.
COLUMNS = [
    "NCT Number", "Title", "Study Title", "Recruitment Status", "Study Type", "Phase", "Enrollment", "Start Date", "Completion Date", "Primary Completion Date", "Last Update", "Brief Summary", "Detailed Description", "Conditions",
    "Keywords", "Allocation", "Intervention Model", "Primary Purpose", "Masking", "Interventions", "Intervention Types", "Eligibility Criteria", "Min Age", "Max Age", "Sex", "Accepts Healthy Volunteers", "Location Countries",
    "Location Cities", "Number of Locations", "Sponsor", "Sponsor Class", "Collaborators", "Study URL",
]
STUDY_URL = "https://clinicaltrials.gov/study/"


def _text(study: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(study, f"$.protocolSection.{path}", "string"), F.lit(""))


def _array(study: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(study, f"$.protocolSection.{path}", "array<variant>"), F.array().cast("array<variant>"))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def flatten(studies: DataFrame, study: str = "study") -> DataFrame:
    """One flat row a study (VARIANT). Missing values are empty texts, elements of a wrong kind are skipped, distinct lists are sorted."""
    v = F.col(study)

    def joined(path: str, name: str | None) -> Column:
        items = _array(v, path)
        if name is None:
            return F.array_join(F.transform(F.filter(items, lambda x: _is(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string")), "; ")
        return F.array_join(F.transform(F.filter(items, lambda x: _is(x, "OBJECT")), lambda x: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(""))), "; ")

    def places(name: str) -> Column:
        values = F.transform(F.filter(locations, lambda x: _is(x, "OBJECT")), lambda x: F.try_variant_get(x, f"$.{name}", "string"))
        return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))), "; ")

    locations = _array(v, "contactsLocationsModule.locations")
    columns = {c: _text(v, path) for c, path in TEXTS.items()} | {c: joined(*where) for c, where in LISTS.items()}
    columns["Enrollment"] = F.try_variant_get(v, "$.protocolSection.designModule.enrollmentInfo.count", "long")
    columns["Location Countries"], columns["Location Cities"] = places("country"), places("city")
    columns["Number of Locations"] = F.size(locations).cast("long")
    columns["Study URL"] = F.concat(F.lit(STUDY_URL), _text(v, "identificationModule.nctId"))
    return studies.select(*(columns[c].alias(c) for c in COLUMNS))


def snake_case(df: DataFrame) -> DataFrame:
    from tessera.functions.text import column_name

    return df.toDF(*(column_name(c) for c in df.columns))


def with_defaults(df: DataFrame, names: dict[str, str], missing: str = "N/A") -> DataFrame:
    """Renamed columns (new -> old), with a default where a value or column is missing."""
    return df.select(*((F.coalesce(F.col(old).cast("string"), F.lit(missing)) if old in df.columns else F.lit(missing)).alias(new) for new, old in names.items()))
