"""Labels and section words of spec sheets and web pages.

Every list in this module is a set of fixed values.
"""
from __future__ import annotations

# Label words of spec sheets (compared by skeleton).
TYPE_LABELS = ["ประเภทสินค้า", "ประเภท", "Type", "Product type"]
CODE_LABELS = ["รหัสสินค้า", "รหัส", "Code", "Model", "รุ่น"]
NOTE_LABELS = ["หมายเหตุ", "Remark", "Note"]
FEATURE_LABELS = ["ลักษณะพิเศษ", "คุณสมบัติพิเศษ", "Feature", "Features"]
SIZE_PREFIXES = ["ขนาด", "Size", "Dimension"]
NOT_A_SIZE = "ของ"

# Line shapes of spec sheets.
SECTION_LINE = r"^(รายละเอียด|ข้อมูลทางเทคนิค|Specification|Technical|INTRODUCTION)"
LETTERHEAD = r"(CO\.,?\s*LTD|บริษัท|Tel\.|Fax|โทร|www\.|e-mail|Soi|ซ\.|ซอย|แขวง|Bangkok|กรุงเทพ)"
FIELD_LINE = r"^\s*([^:：]{1,60}?)\s*[:：]\s*(.*)$"
VALUE_LINE = r"^\s*[:：]\s*(.+)$"
NUMERIC_LINE = r"^[\s\d.,/\-xX×]+$"
NUMBERING = r"^\s*\d+(\.\d+)*\.?\s*"
NUMERIC_LABEL = r"^[\d\s.]+$"

# Headings and labels of word documents.
FEATURE_HEADING = r"^(คุณลักษณะเฉพาะ|รายละเอียด|คุณสมบัติ|Specification)s?\s*:?$"
PAIR_LINE = r"^([^:：]{2,40})\s*[:：]\s*(.+)$"
NOT_A_PAIR_LABEL = r"ISO|มาตรฐาน"
DROPPED_PAIR_LABEL = r"^(รหัส|ประเภทสินค้า)"

# Section headings and page furniture of web product pages.
WEB_SECTIONS = ["material", "colour", "color", "seating function", "other", "function", "features", "feature"]
WEB_FURNITURE = ["Download", "Web 360", "Share"]
WEB_INTRO_STOPS = ["Download", "Web 360", "Material"]
WEB_END_MARK = "เรื่องน่าสนใจ"
WEB_START_MARK = "Share"
DIMENSION_LINE = r"(?i)^dimensions?\s*:?\s*(.*)$"
DIMENSION_STOP = r"(?i)^dimensions?\s*:"
AXIS_LEGEND = r"\s*:?\s*Width\s*x\s*Depth.*$"
SIZE_TRIPLE = r"^([\d.]+)\s*[x×X]\s*([\d.]+)(?:\s*[x×X]\s*([\d.]+))?\s*(mm|cm)?"

# English web label -> Thai label.
LABEL_TH = {
    "material": "วัสดุ", "colour": "สี", "color": "สี", "structure": "โครงสร้าง", "frame": "โครง",
    "upholstery": "วัสดุหุ้ม", "backrest": "พนักพิง", "backrest and headrest": "พนักพิงและพนักพิงศีรษะ",
    "headrest": "พนักพิงศีรษะ", "seat": "ที่นั่ง", "armrest": "ท้าวแขน", "armrests": "ท้าวแขน",
    "base": "ฐาน", "casters": "ล้อ", "castors": "ล้อ", "glides": "ปุ่มรองขา", "leg": "ขา", "legs": "ขา",
    "mechanical unit": "กลไกปรับ", "mechanism": "กลไกปรับ", "certification": "มาตรฐานรับรอง",
    "gas lift": "โช้คปรับระดับ", "adjustable seat": "ปรับเลื่อนที่นั่ง", "adjustable lumbar": "ปรับระดับรองรับหลัง",
    "adjustable headrest": "ปรับพนักพิงศีรษะ", "adjustable armrests": "ปรับท้าวแขน", "top": "แผ่นท็อป",
    "table top": "แผ่นท็อป", "tabletop": "แผ่นท็อป", "edge": "ขอบ", "finish": "ผิวสำเร็จ", "glass": "กระจก",
    "drawer": "ลิ้นชัก", "drawers": "ลิ้นชัก", "door": "บานประตู", "doors": "บานประตู", "handle": "มือจับ",
    "panel": "แผ่น", "panels": "แผ่น", "shelf": "ชั้นวาง", "shelves": "ชั้นวาง", "lock": "กุญแจ",
    "wire management": "ระบบจัดเก็บสายไฟ", "cable management": "ระบบจัดเก็บสายไฟ", "power": "ปลั๊กไฟ",
    "foam": "ฟองน้ำ", "cushion": "เบาะ", "fabric": "ผ้า", "writing tablet": "แผ่นรองเขียน",
    "tablet": "แผ่นรองเขียน", "other": "อื่นๆ", "backrest function": "ฟังก์ชันพนักพิง", "tilt": "ปรับเอน",
    "stacking": "การซ้อน", "linking": "การต่อแถว", "ventilation": "ระบบระบายอากาศ", "lighting": "แสงสว่าง",
    "acoustic": "ซับเสียง", "sound absorption": "ซับเสียง",
}
