"""Synthetic identifiers planted in report texts and DICOM tags, with the truth kept apart. Deterministic by seed."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import schemas

FIRST = ("Mary", "John", "Alice", "Peter", "Nora", "Hugo")
LAST = ("Curie", "Smith", "Keller", "Owens", "Larsen", "Brandt")
GIVEN = ("明月", "小明", "建国", "丽华", "志强")
FAMILY = ("欧阳", "王", "李", "张", "司马")
SEPARATORS = ("-", "/", ".", " ", "－", "／", "．")
COUNTRY = ("", "+86 ", "+86-", "0086-", "86 ")
LABELS = ("MRN", "mrn", "No.", "MRN: ", "MRN\u00a0", "Medical Record Number: ", "病案号：", "住院号: ")
BLANKS = (" ", "\u00a0", "\u3000")


def wide(s: str) -> str:
    """s in full-width letters and digits."""
    return "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in s)


TEMPLATES = (
    "Heart size is normal.",
    "Lungs are clear. No pleural effusion.",
    "Small left pleural effusion is seen.",
    "Mild cardiomegaly, no focal consolidation.",
    "右侧胸腔积液，左肺清晰。",
    "Degenerative changes of the spine.",
    "No pneumothorax. Rib fracture on the right.",
    "双肺纹理清晰，心影不大。",
)


def sample(seed: int) -> tuple:
    """seed, text before, text after planting, tags, truth: six tags and seven items of text."""
    r = random.Random(seed)
    pick, digits = r.choice, lambda n: "".join(r.choice("0123456789") for _ in range(n))
    before = TEMPLATES[seed % len(TEMPLATES)]
    sep, blank, form = pick(SEPARATORS), pick(BLANKS), pick((str, str, wide))
    western, chinese = f"{pick(FIRST)} {pick(LAST)}", pick(FAMILY) + pick(GIVEN)
    doctor = f"{pick(FIRST)} {pick(LAST)}"
    day = [str(r.randint(1990, 2023)), f"{r.randint(1, 12):02d}", f"{r.randint(1, 28):02d}"]
    date = form(sep.join(day if r.random() < 0.7 else day[::-1])) if r.random() < 0.8 else f"{day[0]}年{day[1]}月{day[2]}日"
    number = digits(8)
    label = pick(LABELS)
    mrn = form(number)
    phone = form(f"{pick(COUNTRY)}1{pick('3578')}{digits(1)}{sep}{digits(4)}{sep}{digits(4)}")
    national = digits(17) + pick("0123456789X")
    text = f"Patient:{blank}{western}. 患者：{chinese}，{label}{mrn} {national}. {before} Comparison {date}. Contact {phone}. Reported by:{blank}{doctor}."
    truth = [("name", western, "text"), ("name", chinese, "text"), ("patient_id", mrn, "text"), ("national_id", national, "text"), ("date", date, "text"), ("phone", phone, "text"), ("name", doctor, "text")]
    tags = {"PatientName": f"{pick(LAST)}^{pick(FIRST)}".upper(), "PatientID": digits(8), "PatientBirthDate": f"19{digits(2)}0{r.randint(1, 9)}1{r.randint(0, 9)}", "InstitutionName": f"{pick(LAST)} Hospital", "AccessionNumber": "ACC" + digits(8), "ReferringPhysicianName": f"{pick(FAMILY)}^{pick(GIVEN)}"}
    kinds = {"PatientName": "name", "PatientID": "patient_id", "PatientBirthDate": "birth_date", "InstitutionName": "institution", "AccessionNumber": "accession", "ReferringPhysicianName": "name"}
    truth += [(kinds[k], v, "dicom") for k, v in tags.items()]
    return seed, before, text, {**tags, "Modality": "CR", "Rows": "2048"}, [dict(zip(("kind", "value", "location"), t)) for t in truth]


def samples(spark: SparkSession, n: int = 20) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([sample(int(s)) for s in b["id"]], columns=["seed", "report_text_before", "report_text_after", "dicom_attributes", "ground_truth"])

    return spark.range(n).mapInPandas(run, schemas.PHI)
