"""Ranges of the office catalogue: taxonomy, words that decide a range, and what is printed.

Every list in this module is a set of fixed values.
"""
from __future__ import annotations

# Fixed values: (main number, main code, English name, Thai name).
MAINS = [
    (1, "CH", "Chairs", "เก้าอี้"),
    (2, "CB", "Cupboards", "ตู้"),
    (3, "SH", "Shelves", "ชั้นวาง"),
    (4, "ST", "Sliding Track Cabinets / Mobile Shelving", "ตู้รางเลื่อน"),
    (5, "TB", "Tables", "โต๊ะ"),
    (6, "PT", "Partition Screens", "พาร์ทิชั่น & ฉากกั้น"),
    (7, "GR", "Guest Room Sets", "ชุดรับแขก"),
]

# Fixed values: (main code, range code, English name, Thai name); a main without any is its own range.
SUBS = [
    ("CH", "CH-NT", "Mesh / Net Chairs", "เก้าอี้ตาข่าย"),
    ("CH", "CH-LT", "Leather Chairs", "เก้าอี้หนัง"),
    ("CH", "CH-MP", "Multipurpose Chairs", "เก้าอี้เอนกประสงค์ (ไม่มีล้อ)"),
    ("CH", "CH-MW", "Multipurpose Chairs with Wheels", "เก้าอี้เอนกประสงค์ (มีล้อ)"),
    ("CB", "CB-WD", "Wooden Cupboards", "ตู้ไม้"),
    ("CB", "CB-ST", "Steel Cupboards", "ตู้เหล็ก"),
    ("SH", "SH-WD", "Wooden Shelves", "ชั้นวางไม้"),
    ("SH", "SH-ST", "Steel Shelves", "ชั้นวางเหล็ก"),
    ("TB", "TB-WD", "Wooden Tables", "โต๊ะไม้"),
    ("TB", "TB-ST", "Full Steel Tables", "โต๊ะเหล็ก"),
    ("TB", "TB-WS", "Wood + Steel Tables", "โต๊ะไม้ขาเหล็ก"),
    ("TB", "TB-MT", "Meeting Tables", "โต๊ะประชุม"),
]

# Category groups.
CHAIR_CATEGORIES = ["office-chairs", "visitor-chairs", "training-chairs", "waiting-chairs"]
TABLE_CATEGORIES = ["desks", "workstations", "executive-desks", "desk-extensions", "multipurpose-tables"]
GUEST_CATEGORIES = ["sofas", "sofa-beds", "coffee-tables"]
WOOD_BOARDS = ["particle-board", "melamine", "veneer", "hpl", "solid-wood"]
LEATHERS = ["pu-leather", "genuine-leather"]

# Word patterns that decide a range.
MOBILE = (r"ตู้รางเลื่อน|รางเลื่อน\s*รุ่น|ตู้เอกสารแบบมีรางเลื่อน|mobile\s*(storage|shelv)|sliding\s*track|"
          r"compactus|mobile\s*cabinet")
NOT_MOBILE = r"ลิ้นชัก|drawer|keyboard|คีย์บอร์ด"
MESH = r"ตาข่าย|เน็ท|เน็ต|mesh|\bnet\b"
LEATHER = r"หนัง|leather"
FIXED_BASE = r"ไม่มีล้อ|ขาตาย|ขาเหล็กดัด|ขาตัว\s*[CcUu]|4\s*ขา|sled|cantilever"
WHEELS = r"ล้อ|caster|castor|wheel"
SHELF = r"^\s*(ชั้น|shelf|shelv|rack)"
PARTITION = r"partition|patition|พาร์ทิชั่น|พาทิชั่น|ฉากกั้น|แผงกั้น|ผนังกั้น|สกรีน|screen|บังตา|เสาจับ"
RECEPTION = r"ประชาสัมพันธ์|ต้อนรับ|reception|เคาน์เตอร์สูง|จำหน่ายบัตร|^\s*เคาน์เตอร์\s*$"
NOT_OFFICE = r"อาหาร|ทานข้าว|ครัว|แต่งตัว|เครื่องแป้ง|คนไข้|ผู้ป่วย|dining|kitchen|dressing"
STEEL = r"เหล็ก|steel|metal|สแตนเลส|stainless"
WOOD = r"ไม้|wood|melamine|เมลามีน|particle|MDF|veneer|วีเนียร์|HPL|laminate|ลามิเนต"
STEEL_WARDROBE = r"เหล็ก|steel|ล็อคเกอร์|ล็อกเกอร์|locker"
MEETING = r"โต๊ะประชุม|meeting|conference"
CABINET_HEAD = r"^\s*ตู้"

# Main-material classification of case goods.
SEATING = ["office-chairs", "visitor-chairs", "training-chairs", "waiting-chairs", "dining-chairs", "stools", "bar"]
SOFT = ["sofas", "sofa-beds", "recliners", "armchairs", "beds"]
TYPE_STEEL, TYPE_STEEL_LEGS = r"เหล็ก|steel", r"ขาเหล็ก|steel leg|steel frame"
TYPE_WOOD, TYPE_WOOD_LEGS = r"ไม้|wood", r"ขาไม้|wood leg"
TEXT_WOOD = (r"ไม้|wood|particle|MDF|melamine|เมลามีน|veneer|วีเนียร์|HPL|laminate|ลามิเนต|plywood|ไม้อัด|\bPB\b|"
             r"oak|beech")
TEXT_STEEL = (r"เหล็ก|steel|metal|SPCC|stainless|สแตนเลส|locker|ล็อกเกอร์|ล็อคเกอร์|ตู้นิรภัย|safe\b")
STEEL_SOURCES = [r"/STEEL/", r"LOCKER"]
WOOD_SOURCES = [r"/WOOD/", r"/WARDROBE/", r"/KITCHEN/"]

# Material code -> printed name, and what a range implies when the sheet names none.
MATERIAL_EN = {
    "steel": "Steel", "chrome": "Chrome-plated steel", "aluminium": "Aluminium", "plastic": "Plastic (PP)",
    "mesh": "Mesh", "pu-leather": "PU leather", "genuine-leather": "Genuine leather", "fabric": "Fabric",
    "particle-board": "Particle board", "melamine": "Melamine", "veneer": "Wood veneer", "hpl": "HPL laminate",
    "solid-wood": "Solid wood", "glass": "Glass",
}
RANGE_MATERIAL = {
    "CH-NT": ["Mesh"], "CH-LT": ["Leather / PU leather"], "CB-WD": ["Wood"], "CB-ST": ["Steel"],
    "SH-WD": ["Wood"], "SH-ST": ["Steel"], "TB-WD": ["Wood"], "TB-ST": ["Steel"],
    "TB-WS": ["Wooden top", "Steel frame"],
}

# Tags that count as a printed feature.
FEATURE_TAGS = [
    "casters", "armrests", "height-adjustable", "drawers", "lockable", "high-back", "mid-back", "low-back",
    "headrest", "reclining", "foldable", "writing-tablet", "stackable", "electric",
]

# Fixed values: (pattern, colour name) in printed order, and the wording for colours made to order.
COLOUR_RULES = [
    (r"สีดำ|\bblack\b", "Black"), (r"สีขาว|\bwhite\b", "White"), (r"สีเทา|\bgr[ae]y\b", "Grey"),
    (r"สีน้ำตาล|\bbrown\b", "Brown"), (r"สีครีม|\bcream\b", "Cream"), (r"สีเบจ|\bbeige\b", "Beige"),
    (r"สีแดง|\bred\b", "Red"), (r"สีน้ำเงิน|\bnavy\b", "Navy blue"), (r"สีฟ้า|\bblue\b", "Blue"),
    (r"สีเขียว|\bgreen\b", "Green"), (r"สีเหลือง|\byellow\b", "Yellow"), (r"สีส้ม|\borange\b", "Orange"),
    (r"สีชมพู|\bpink\b", "Pink"), (r"สีม่วง|\bpurple\b", "Purple"), (r"สีเงิน|\bsilver\b", "Silver"),
    (r"สีทอง|\bgold\b", "Gold"), (r"บีช|\bbeech\b", "Beech"), (r"โอ๊ค|\boak\b", "Oak"),
    (r"วอลนัท|\bwalnut\b", "Walnut"), (r"เชอร์รี่|\bcherry\b", "Cherry"),
]
COLOUR_TO_ORDER = r"ระบุ(สี)?ภายหลัง|สีมาตร(ฐ|ร)?าน|สีตามมาตรฐาน|standard colou?r"
COLOUR_TO_ORDER_NAME = "standard colours to order"
