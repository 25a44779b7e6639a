"""Frozen profiles: the values that differ from corpus to corpus.

A profile holds small fixed tables (splits, prefixes, expected counts, label
equivalence).  Operators take a profile, so a new corpus needs no new code.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Profile:
    language: str
    splits: tuple[str, ...]
    prefixes: Mapping[str, str]
    generated_dataset: str
    pristine_dataset: str
    label_equivalence: Mapping[str, str] = field(
        default_factory=lambda: {"pristine": "bonafide", "generated": "spoof"})
    expected_counts: Mapping[tuple[str, str], int] = field(default_factory=dict)
    sparse_fields: Mapping[str, str] = field(default_factory=dict)
    archive_prefixes: Mapping[str, str] = field(default_factory=dict)
    required_names: tuple[str, ...] = ()
    metadata_source: str = "two-source-verified"
    generated_root: str = "dataset/generated"
    pristine_root: str = "raw/pristine"

    def __post_init__(self) -> None:
        for name in ("prefixes", "label_equivalence", "expected_counts", "sparse_fields",
                     "archive_prefixes"):
            object.__setattr__(self, name, MappingProxyType(dict(getattr(self, name))))

    def split_order(self, split: Column) -> Column:
        """Position of a split in the profile; unknown splits come last."""
        order = F.lit(len(self.splits))
        for i, s in reversed(list(enumerate(self.splits))):
            order = F.when(split == s, i).otherwise(order)
        return order

    def equivalent_label(self, label: Column) -> Column:
        """Label of the other publisher."""
        pairs = [F.lit(x) for kv in self.label_equivalence.items() for x in kv]
        return F.element_at(F.create_map(*pairs), label)

    def split_of_archive(self, name: Column) -> Column:
        """Split by archive name prefix, null when none fits."""
        out = F.lit(None).cast("string")
        for prefix, split in reversed(list(self.archive_prefixes.items())):
            out = F.when(name.startswith(prefix), split).otherwise(out)
        return out

    def expected(self, spark: SparkSession) -> DataFrame:
        rows = [(s, l, n) for (s, l), n in self.expected_counts.items()]
        return spark.createDataFrame(rows, "split string, label string, expected long")


# Published row counts, prefixes and directory rules of three corpora.
ENGLISH = Profile(
    language="eng", splits=("train", "dev"),
    prefixes={"train": "T", "dev": "D", "eval": "E"},
    generated_dataset="ASVspoof2024", pristine_dataset="ASVspoof2024",
    expected_counts={("train", "pristine"): 18797, ("dev", "pristine"): 15667,
                     ("train", "generated"): 65424, ("dev", "generated"): 54808},
    archive_prefixes={"flac_T_": "train", "flac_D_": "dev"},
    required_names=("flac_T_aa.tar", "flac_T_ab.tar", "flac_T_ac.tar", "flac_T_ad.tar",
                    "flac_T_ae.tar", "flac_D_aa.tar", "flac_D_ab.tar", "flac_D_ac.tar"),
    generated_root="dataset/English_ASVspoof2024_Generated")
PORTUGUESE = Profile(
    language="por", splits=("train", "dev", "eval"),
    prefixes={"train": "T", "dev": "D", "eval": "E"},
    generated_dataset="MLAAD", pristine_dataset="CORAA",
    expected_counts={("train", "generated"): 1806, ("dev", "generated"): 602,
                     ("eval", "generated"): 603, ("train", "pristine"): 382258,
                     ("dev", "pristine"): 7522, ("test", "pristine"): 12676},
    generated_root="dataset/Portugese_MLAAD_Generated")
MANDARIN = Profile(
    language="zho", splits=("train", "dev", "eval"),
    prefixes={"train": "T", "dev": "D", "eval": "E"},
    generated_dataset="ADD", pristine_dataset="AISHELL3",
    expected_counts={("train", "generated"): 7146, ("dev", "generated"): 7497,
                     ("eval", "generated"): 9999},
    sparse_fields={"attack_id": "unk", "gender": "unk", "spk_id": "unk", "codec": "-",
                   "native": "yes"},
    required_names=("spk-info.txt", "train/content.txt", "test/content.txt",
                    "train/label_train-set.txt"),
    generated_root="dataset/Chinese_ADD_Generated")
