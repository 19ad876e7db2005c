"""Vocabularies and constants. All values here are fixed values: results depend on them to the letter."""

from __future__ import annotations

# Written names of each canonical label. The canonical name itself is a name too.
ALIASES: dict[str, tuple[str, ...]] = {
    "Atelectasis": ("Atelectasis", "肺不张", "Pulmonary Atelectasis"),
    "Consolidation": ("Consolidation", "实变", "肺实变"),
    "Infiltration": ("Infiltration", "浸润影", "肺浸润"),
    "Pneumothorax": ("Pneumothorax", "气胸", "左侧气胸", "右侧气胸"),
    "Edema": ("Edema", "Pulmonary Edema", "肺水肿"),
    "Emphysema": ("Emphysema", "肺气肿"),
    "Fibrosis": ("Fibrosis", "Pulmonary Fibrosis", "肺纤维化"),
    "PleuralEffusion": ("Effusion", "Pleural Effusion", "胸腔积液", "右侧胸腔积液", "左侧胸腔积液", "胸水"),
    "Pneumonia": ("Pneumonia", "肺炎"),
    "PleuralThickening": ("Pleural_Thickening", "Pleural Thickening", "胸膜增厚"),
    "Cardiomegaly": ("Cardiomegaly", "心影增大", "心脏扩大"),
    "Nodule": ("Nodule", "结节", "肺结节"),
    "Mass": ("Mass", "肿块"),
    "Hernia": ("Hernia", "疝", "膈疝"),
    "LungLesion": ("Lung Lesion", "肺部病变"),
    "Fracture": ("Fracture", "骨折", "Rib Fracture", "肋骨骨折", "Clavicle Fracture", "锁骨骨折", "Vertebral Fracture", "椎体骨折", "Fractures, Bone"),
    "LungOpacity": ("Lung Opacity", "肺部阴影", "肺部密度增高影"),
    "EnlargedCardiomediastinum": ("Enlarged Cardiomediastinum", "纵隔增宽"),
    "Pneumomediastinum": ("Pneumomediastinum", "Mediastinal Emphysema", "纵隔气肿", "气纵隔"),
}
# Labels that alert, and labels on which readers are compared.
CRITICAL = ("Pneumothorax", "PleuralEffusion", "Pneumomediastinum")
COMPARISON = ("Cardiomegaly", "LungOpacity", "PleuralEffusion", "Pneumonia", "Pneumothorax", "Fracture", "Pneumomediastinum")

# Confidence words and their scores.
CONFIDENCE: dict[float, tuple[str, ...]] = {
    0.9: ("certain", "definite", "definitely", "confirmed", "clearly", "obvious", "确定", "明确", "肯定"),
    0.6: ("probable", "likely", "suspected", "suspicious", "可能性大", "怀疑", "考虑", "倾向于"),
    0.3: ("possible", "possibly", "cannot exclude", "cannot rule out", "can't rule out", "equivocal", "uncertain", "不除外", "不排除", "待排", "可能"),
}
# Side and severity words that a label may carry.
QUALIFIERS = (
    "left", "right", "bilateral", "biapical", "apical", "basal", "basilar", "upper", "lower", "mid", "middle", "zone", "lobe", "sided",
    "mild", "moderate", "severe", "small", "large", "minimal", "trace", "slight", "marked", "massive", "tiny", "extensive", "subtle", "possible",
)
CJK_QUALIFIER = "(左侧|右侧|双侧|两侧|左|右|双|轻度|中度|重度|少量|中量|大量|微量|明显|轻微)"
NEGATED_LABEL = r"(?i)^(no|not|without|negative for|free of|clear of|absence of|absent|normal|unremarkable)\b|^(未见|未发现|未及|无|没有|阴性)"

# Mention scanning.
MENTION_KEYWORDS = {"pneumothorax": "Pneumothorax", "pneumomediastinum": "Pneumomediastinum", "mediastinal emphysema": "Pneumomediastinum", "pleural effusion": "PleuralEffusion", "effusion": "PleuralEffusion"}
NEGATION_TRIGGERS = (
    "no ", "no evidence of", "no significant", "without", "free of", "absence of", "not seen", "not appreciated", "not identified", "not present",
    "negative for", "ruled out", "rules out", "unremarkable for", "clear of",
)
HEDGE_TRIGGERS = (
    "cannot exclude", "can not exclude", "cannot rule out", "can not rule out", "can't exclude", "can't rule out", "possible", "questionable", "suspicious for",
    "concerning for", "may represent", "less apparent", "less perceptible", "history of",
)
LARGE_WORDS = ("large", "massive", "sizable", "moderate to large")
SMALL_WORDS = ("small", "trace", "tiny", "minimal", "minute")

# DICOM keywords that pass.
DICOM_ALLOWED = (
    "Modality", "ImageType", "ViewPosition", "PatientOrientation", "PatientSex", "PatientAge", "BodyPartExamined", "Rows", "Columns", "PhotometricInterpretation",
    "SamplesPerPixel", "PlanarConfiguration", "BitsAllocated", "BitsStored", "HighBit", "PixelRepresentation", "PixelSpacing", "WindowCenter", "WindowWidth",
    "RescaleIntercept", "RescaleSlope", "PixelData",
)

# Report sections in order, and those whose sentences are claims.
SECTIONS = ("technique", "findings", "impression", "recommendation")
CLAIM_SECTIONS = ("findings", "impression", "recommendation")

# Surnames, compound ones first.
COMPOUND_SURNAMES = ("欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "长孙", "宇文", "慕容", "令狐", "独孤", "南宫", "万俟", "拓跋")
SINGLE_SURNAMES = (
    "李", "王", "张", "刘", "陈", "杨", "黄", "赵", "周", "吴", "徐", "孙", "胡", "朱", "高", "林", "何", "郭", "马", "罗",
    "梁", "宋", "郑", "谢", "韩", "唐", "冯", "于", "董", "萧", "程", "曹", "袁", "邓", "许", "傅", "沈", "曾", "彭", "吕",
    "苏", "卢", "蒋", "蔡", "贾", "丁", "魏", "薛", "叶", "阎", "余", "潘", "杜", "戴", "夏", "钟", "汪", "田", "任", "姜",
    "范", "方", "石", "姚", "谭", "廖", "邹", "熊", "金", "陆", "郝", "孔", "白", "崔", "康", "毛", "邱", "秦", "江", "史",
    "顾", "侯", "邵", "孟", "龙", "万", "段", "雷", "钱", "汤", "尹", "黎", "易", "常", "武", "乔", "贺", "赖", "龚", "文",
    "欧",
)
# Characters that vanish, and the full-width ones that fold.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
SOFT_HYPHEN = "\u00ad"
KEY_STRIP = r"""[\s_\-.,;:!?'"()/、，。！？；：（）]+"""
# A disclaimer names a machine and a review.
MACHINE_WORDS = ("AI", "人工智能", "机器")
REVIEW_WORDS = ("复核", "审核", "医师", "医生", "签发")
# Identifiers of a DICOM file's meta group.
FILE_META_IDENTIFIERS = ("SourceApplicationEntityTitle", "PrivateInformationCreatorUID", "MediaStorageSOPInstanceUID", "ImplementationVersionName", "ImplementationClassUID")
FILM_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "html": "text/html", "dcm": "application/dicom"}
