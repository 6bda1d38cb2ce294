"""Standardised contact columns and text gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.functions.text import formatted_address, formatted_company, formatted_message, formatted_person, formatted_phone

PHONE = r"\+?[0-9]*[ (-]+[0-9]{3}[) -]+[0-9]{3}-[0-9]{4}"
def phones(documents: DataFrame) -> DataFrame:
    """Distinct phone numbers of each text, as found and formatted."""
    found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PHONE), F.lit(0))).alias("phone")).distinct()
    return found.select("doc_id", "phone", formatted_phone(F.col("phone")).alias("formatted"))


def standardised(values: DataFrame) -> DataFrame:
    """values(id, field, type, value) in the form of their field, told by its name and type; null values dropped."""
    name, kind, value = F.lower("field"), F.coalesce("type", F.lit("")), F.trim("value")
    form = (
        F.when(name.rlike("email|mail") | (kind == "email"), formatted_address(value)).when(name.rlike("phone|tel|電話") | (kind == "tel"), formatted_phone(value)).when(name.rlike("name|名前"), formatted_person(value))
        .when(name.rlike("company|会社"), formatted_company(value)).when((kind == "textarea") | name.rlike("message|内容"), formatted_message(value)).otherwise(value)
    )
    return values.where("value is not null").select("id", "field", form.alias("value"))


def scripts(documents: DataFrame) -> DataFrame:
    """Kana, ideographs and accented letters in each text."""
    count = lambda cls: F.regexp_count("text", F.lit(cls)).cast("long")
    return documents.select("doc_id", count("[぀-ヿ]").alias("n_kana"), count("[一-鿿]").alias("n_ideographs"), count("[À-ɏ]").alias("n_accented"))
