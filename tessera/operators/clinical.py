"""Health-record bundles (VARIANT) to patient records, and their text summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import age_at, partial_date

#: Fixed value: the code of smoking status.
SMOKING = "72166-2"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _items(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _coded(v: Column, path: str, missing: str) -> Column:
    """A concept's first coding's display, else its text, else a default."""
    return F.coalesce(_get(v, f"{path}.coding[0].display"), _get(v, f"{path}.text"), F.lit(missing))


def resources(bundle: Column) -> Column:
    """(kind, resource) of each entry of a bundle, in its order."""
    found = F.transform(_items(bundle, "entry"), lambda e: _get(e, "resource", "variant"))
    return F.transform(found, lambda r: F.struct(_get(r, "resourceType").alias("kind"), r.alias("resource")))


def demographics(r: Column, as_of: Column) -> Column:
    race = F.filter(_items(r, "extension"), lambda e: F.coalesce(_get(e, "url"), F.lit("")).contains("us-core-race"))
    texts = F.transform(F.flatten(F.transform(race, lambda e: F.filter(_items(e, "extension"), lambda s: _get(s, "url") == "text"))), lambda s: _get(s, "valueString"))
    gender, born = F.lower(F.coalesce(_get(r, "gender"), F.lit("unknown"))), partial_date(_get(r, "birthDate"))
    return F.struct(
        F.coalesce(_get(r, "id"), F.lit("Unknown")).alias("patient_id"), F.lit(None).cast("string").alias("firebase_uid"), born.alias("date_of_birth"), age_at(born, as_of).alias("age"),
        F.when(gender.isin("male", "female", "other"), gender).otherwise("unknown").alias("gender"), F.try_element_at(texts, F.lit(-1)).alias("race"), _get(r, "maritalStatus.coding[0].display").alias("marital_status"),
        _get(r, "address[0].city").alias("city"), _get(r, "address[0].state").alias("state"), _get(r, "address[0].country").alias("country"),
    )


def condition(r: Column) -> Column:
    status = _get(r, "clinicalStatus.coding[0].code")
    return F.struct(
        F.coalesce(_get(r, "code.coding[0].code"), F.lit("unknown")).alias("code"), _coded(r, "code", "Unknown condition").alias("display_name"), partial_date(_get(r, "onsetDateTime")).alias("onset_date"),
        partial_date(_get(r, "abatementDateTime")).alias("abatement_date"), F.when(status.isin("resolved", "remission", "recurrence"), status).otherwise("active").alias("status"),
    )


def medication(r: Column) -> Column:
    return F.struct(
        _get(r, "medicationCodeableConcept.coding[0].code").alias("code"), _coded(r, "medicationCodeableConcept", "Unknown medication").alias("display_name"), _get(r, "dosageInstruction[0].text").alias("dosage"),
        _get(r, "dosageInstruction[0].route.text").alias("route"), partial_date(_get(r, "authoredOn")).alias("start_date"), F.coalesce(_get(r, "status"), F.lit("active")).alias("status"), _get(r, "reasonCode[0].text").alias("reason"),
    )


def observation(r: Column, as_of: Column) -> Column:
    quantity = _get(r, "valueQuantity", "variant").isNotNull()
    return F.struct(
        F.coalesce(_get(r, "code.coding[0].code"), F.lit("unknown")).alias("code"), _coded(r, "code", "Unknown observation").alias("display_name"), _get(r, "valueQuantity.value", "double").alias("value"),
        F.when(~quantity, F.coalesce(_get(r, "valueString"), _get(r, "valueCodeableConcept.text"))).alias("value_string"), _get(r, "valueQuantity.unit").alias("unit"),
        _get(r, "referenceRange[0].low.value", "double").alias("reference_range_low"), _get(r, "referenceRange[0].high.value", "double").alias("reference_range_high"),
        F.coalesce(partial_date(_get(r, "effectiveDateTime")), as_of).alias("date"), _get(r, "category[0].coding[0].code").alias("category"),
    )


def procedure(r: Column, as_of: Column) -> Column:
    return F.struct(
        F.coalesce(_get(r, "code.coding[0].code"), F.lit("unknown")).alias("code"), _coded(r, "code", "Unknown procedure").alias("display_name"),
        F.coalesce(partial_date(_get(r, "performedDateTime")), partial_date(_get(r, "performedPeriod.start")), as_of).alias("performed_date"), _get(r, "bodySite[0].text").alias("body_site"), _get(r, "reasonCode[0].text").alias("reason"),
    )


def allergy(r: Column) -> Column:
    texts = F.flatten(F.transform(_items(r, "reaction"), lambda x: F.transform(_items(x, "manifestation"), lambda m: F.coalesce(_get(m, "text"), F.lit("")))))
    return F.struct(
        F.coalesce(_get(r, "code.text"), F.lit("Unknown substance")).alias("substance"), _get(r, "criticality").alias("criticality"), F.when(F.size(texts) > 0, texts).alias("reaction"), partial_date(_get(r, "onsetDateTime")).alias("onset_date"),
        F.coalesce(_get(r, "type"), F.lit("allergy")).alias("type"),
    )


def patients(bundles: DataFrame, keys: list[str], as_of: Column, bundle: str = "bundle") -> DataFrame:
    """One nested patient record a bundle; lists keep the bundle's order, and a bundle without a patient gives no row.

    A record is made of its own bundle alone, so nothing is shuffled, and each entry is read for its own kind only.
    """

    def listed(name: str, make: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter("entries", lambda e: e["kind"] == name), lambda e: make(e["resource"]))

    smoking = F.filter("entries", lambda e: (e["kind"] == "Observation") & (_get(e["resource"], "code.coding[0].code") == SMOKING))
    out = bundles.select(*keys, resources(F.col(bundle)).alias("entries"))
    out = out.where(F.exists("entries", lambda e: e["kind"] == "Patient")).select(
        *keys, F.transform(F.slice(F.filter("entries", lambda e: e["kind"] == "Patient"), 1, 1), lambda e: demographics(e["resource"], as_of))[0].alias("demographics"),
        listed("Condition", condition).alias("conditions"), listed("MedicationRequest", medication).alias("medications"), listed("Observation", lambda r: observation(r, as_of)).alias("observations"),
        listed("Procedure", lambda r: procedure(r, as_of)).alias("procedures"), listed("AllergyIntolerance", allergy).alias("allergies"), F.transform(smoking, lambda e: _get(e["resource"], "valueCodeableConcept.text")).alias("smoking"),
    )
    last = F.try_element_at("smoking", F.lit(-1))
    nothing = F.lit(None).cast("string")
    return out.withColumn("lifestyle", F.when(F.coalesce(last, F.lit("")) != "", F.struct(last.alias("smoking_status"), nothing.alias("alcohol_use")))).drop("smoking")


def active_conditions(conditions: Column) -> Column:
    return F.filter(conditions, lambda c: c["status"] == "active")


def recent(observations: Column, as_of: Column, days: int) -> Column:
    return F.filter(observations, lambda o: o["date"] >= F.date_sub(as_of, days))


def summary(as_of: Column, days: int = 365) -> Column:
    """The text of a patient record with columns demographics, conditions, medications, observations, procedures, allergies, lifestyle."""
    d = F.col("demographics")

    def names(label: str, items: Column, name: str = "display_name", separator: str = ", ") -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.transform(items, lambda x: x[name]), separator), F.lit(".")))

    def shown(o: Column) -> Column:
        has = F.coalesce(o["value"], F.lit(0.0)) != 0
        return F.when(has, F.concat(o["display_name"], F.lit(": "), o["value"].cast("string"), F.lit(" "), F.coalesce(o["unit"], F.lit("None")))).otherwise(F.concat(o["display_name"], F.lit(": "), F.coalesce(o["value_string"], F.lit("None"))))

    seen = F.transform(F.slice(recent(F.col("observations"), as_of, days), 1, 5), shown)
    late = F.transform(F.col("procedures"), lambda p, i: F.struct(-F.unix_date(p["performed_date"]), i, p["display_name"].alias("display_name")))
    who = F.concat(F.lit("Patient is a "), d["age"].cast("string"), F.lit("-year-old "), d["gender"], F.when(F.coalesce(d["race"], F.lit("")) != "", F.concat(F.lit(" "), d["race"])).otherwise(""), F.lit("."))
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value, F.lit(".")))
    return F.concat_ws(
        " ", who, names("Active diagnoses", active_conditions(F.col("conditions"))), names("Current medications", F.filter("medications", lambda m: m["status"] == "active")),
        F.when(F.size(seen) > 0, F.concat(F.lit("Recent observations: "), F.array_join(seen, "; "), F.lit("."))), names("Recent procedures", F.slice(F.array_sort(late), 1, 3)), names("Known allergies", F.col("allergies"), "substance"),
        line("Smoking status", F.col("lifestyle.smoking_status")), line("Alcohol use", F.col("lifestyle.alcohol_use")),
    )
