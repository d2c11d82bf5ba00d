"""Overlap scores of folder pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a folder name that mark a backup, and the weights of the score.
BACKUP_TOKENS = ("backup", "copy", "old", "temp", "temporary")
HASH_WEIGHT, SIGNATURE_WEIGHT, NAME_WEIGHT, NAME_BONUS = 0.55, 0.35, 0.10, 0.2


def ratio(a: Column, b: Column) -> Column:
    """Smaller by larger; 0 when either is 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    """Intersection by union of sets of sizes a and b; 0 when both are empty."""
    union = a + b - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def looks_like_backup(name: Column, tokens=BACKUP_TOKENS) -> Column:
    """Whether the lower-cased name contains one of the tokens anywhere."""
    found = F.lit(False)
    for token in tokens:
        found = found | F.lower(name).contains(token)
    return found


def name_bonus(a: Column, b: Column, tokens=BACKUP_TOKENS) -> Column:
    return F.when(looks_like_backup(a, tokens) | looks_like_backup(b, tokens), F.lit(NAME_BONUS)).otherwise(F.lit(0.0))


def score(hash_jaccard: Column, signature_jaccard: Column, bonus: Column) -> Column:
    return F.lit(HASH_WEIGHT) * hash_jaccard + F.lit(SIGNATURE_WEIGHT) * signature_jaccard + F.lit(NAME_WEIGHT) * bonus


def reason(shared_hashes: Column, shared_signatures: Column, bonus: Column) -> Column:
    return F.format_string("shared_duplicate_files=%d, shared_signatures=%d, name_bonus=%.2f", shared_hashes, shared_signatures, bonus)
