"""The fact store: classes, entities, facts and mentions, filled by idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(entity: Column, prop: Column, value: Column) -> Column:
    """Identity of a fact: trimmed value; numbers as doubles, however they are written."""
    number = value.try_cast("double")
    text = F.when(number.isNotNull(), number.cast("string")).otherwise(F.trim(value))
    return F.sha2(F.concat_ws("\x1f", entity.cast("string"), prop, text), 256)


def facts_of(mentions: DataFrame) -> DataFrame:
    """(fact, entity, property, value, n_mentions, first_message) per distinct fact of mentions (entity, property, value, message)."""
    m = mentions.where("entity is not null and property is not null and value is not null").withColumn("fact", signature(F.col("entity"), F.col("property"), F.col("value")))
    return m.groupBy("fact").agg(F.min("entity").alias("entity"), F.min("property").alias("property"), F.min(F.trim("value")).alias("value"), F.countDistinct("message").alias("n_mentions"), F.min("message").alias("first_message"))


def apply_facts(store: DataFrame, new: DataFrame) -> DataFrame:
    """Append the facts the store lacks; applying the same facts again adds nothing."""
    return store.unionByName(new.select(*store.columns).join(store.select("fact"), "fact", "left_anti"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(entity, property, n_values) where an entity has several values of one property."""
    return facts.groupBy("entity", "property").agg(F.count("*").alias("n_values")).where("n_values > 1")


def first_properties(mentions: DataFrame) -> DataFrame:
    """(property, first_message): the history row a property gets when it is first inserted."""
    return mentions.where("property is not null").groupBy("property").agg(F.min("message").alias("first_message"))


def last_entities(seen: DataFrame) -> DataFrame:
    """(entity, label, message) of seen (entity, label, message): the label of the last message counts, the smallest label if it gave several."""
    return seen.where("entity is not null").groupBy("entity").agg(F.max("message").alias("message"), F.min_by("label", F.struct((-F.col("message")).alias("m"), "label")).alias("label")).select("entity", "label", "message")


def mentions_of(mentions: DataFrame) -> DataFrame:
    """(fact, message) once each: a fact mentioned again by a message adds nothing."""
    m = mentions.where("entity is not null and property is not null and value is not null")
    return m.select(signature(F.col("entity"), F.col("property"), F.col("value")).alias("fact"), "message").distinct()
