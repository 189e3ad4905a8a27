"""Fixed values of the label-screening domain.

Everything in this file is data, not logic: word lists, lookup tables,
patterns and thresholds whose exact content decides the results.
"""

# --------------------------------------------------------------------------
# Texts that mean "nothing was read"
# --------------------------------------------------------------------------
ABSENT_TEXTS = [
    "none", "null", "not detected", "not_detected",
    "cannot verify / not detected", "cannot verify", "cannot_verify",
    "n/a", "na", "unknown", "unspecified",
    "missing", "not available", "empty",
]

# --------------------------------------------------------------------------
# Thresholds (percent unless stated)
# --------------------------------------------------------------------------
PRESENT_MIN_CONFIDENCE = 75.0
MISSING_FAIL_CONFIDENCE = 85.0
PRICE_MIN_CONFIDENCE = 85.0
EXTRACTION_MIN_CONFIDENCE = 60.0
DEFAULT_CONFIDENCE = 90.0
LINE_MIN_CONFIDENCE = 0.40
FUTURE_GRACE_DAYS = 31
MAX_FILE_BYTES = 25 * 1024 * 1024
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]

# --------------------------------------------------------------------------
# Rule vocabulary
# --------------------------------------------------------------------------
RULE_TYPES = [
    "MANDATORY_FIELD", "VALUE_CHECK", "FORMAT_CHECK", "RANGE_CHECK",
    "DATE_CHECK", "TEXT_CHECK", "CONDITIONAL_RULE",
    "PRESENCE", "UNIT", "FORMAT", "DATE", "NUMERIC", "DIMENSION",
    "CONDITIONAL", "APPLICABILITY_EXCLUSION", "CROSS_FIELD",
]
RULE_TYPE_ALIASES = {
    "PRESENCE": "MANDATORY_FIELD",
    "UNIT": "VALUE_CHECK",
    "FORMAT": "FORMAT_CHECK",
    "DIMENSION": "FORMAT_CHECK",
    "DATE": "DATE_CHECK",
    "NUMERIC": "RANGE_CHECK",
    "CONDITIONAL": "CONDITIONAL_RULE",
    "APPLICABILITY_EXCLUSION": "CONDITIONAL_RULE",
    "CROSS_FIELD": "CONDITIONAL_RULE",
}
GENERIC_CATEGORIES = [
    "ALL", "All Commodities", "Pre-Packaged Commodities",
    "General Commodities", "*", "pre_packaged_general",
]
OPTIONAL_FIELDS = [
    "allergen_declaration", "allergen", "allergens", "allergen_info",
    "voluntary_marks", "barcode", "gtin", "qr_code", "eco_mark",
    "green_dot", "veg_nonveg_symbol_voluntary",
]
CORE_FIELDS = [
    "manufacturer", "manufacturer_or_importer_name_address", "packer",
    "product_name", "generic_name", "common_generic_name",
    "net_quantity", "net_quantity_unit", "unit_of_measurement", "net_quantity_numeral",
    "manufacturing_date", "manufacture_pack_import_date", "month_year_of_manufacture",
    "mrp", "maximum_retail_price", "retail_price", "retail_sale_price",
    "mrp_inclusive_tax", "mrp_label_format",
    "unit_sale_price", "usp",
    "consumer_care", "customer_care",
    "country_of_origin",
]
PRICE_RULE_FIELDS = ["mrp", "mrp_inclusive_tax", "mrp_label_format", "mrp_declaration"]
PSEUDO_RULE_PREFIXES = ["DECL-", "VIS-", "OCR-DET-", "rule_"]
RETIRED_RULE_IDS = [
    "LM-PCR-2011-R06-S1-F-CARE",
    "FSSAI-LDR-2020-R05-S2-ING",
    "FSSAI-LDR-2020-R05-S3-ALG",
    "LM-CR-001", "LM-CR-001B", "LM-CR-003", "LM-CR-004", "LM-CR-004B",
    "LM-CR-005", "LM-CR-006", "LM-CR-007", "LM-CR-007B", "LM-CR-007C",
    "LM-CR-007D", "LM-CR-007E", "LM-CR-011",
]
NOT_REQUIRED_RULE_IDS = [
    "LM-CR-008", "LM-CR-011", "LM-CR-012", "LM-CR-013", "LM-CR-014", "LM-CR-015",
    "LM-CR-016", "LM-CR-017", "LM-CR-018", "LM-CR-019", "LM-CR-020", "LM-CR-021",
    "LM-CR-022", "LM-CR-023", "LM-CR-024", "LM-CR-025", "LM-CR-001B", "LM-CR-005B",
    "LM-CR-007D", "LM-CR-007E", "LM-CR-009B", "LM-CR-012B", "LM-CR-013B",
]
DEFAULT_ALLOWED_UNITS = ["g", "kg", "ml", "l", "m", "cm", "mm", "number"]
TAX_PHRASES = [
    "inclusive of all taxes", "incl. of all taxes", "incl of all taxes",
    "incl. all taxes", "incl taxes", "all taxes incl", "all taxes included",
    "inclusive of taxes", "incl. taxes", "maximum retail price", "mrp", "₹", "rs",
]
TAX_WORDS = ["incl", "tax", "inclusive", "all taxes"]
MEASURE_UNITS = ["g", "kg", "mg", "ml", "l", "ltr", "gm", "m", "cm", "mm"]

# Applicability tag -> category, in priority order
APPLICABILITY_CATEGORIES = [
    ("pre_packaged_general", "ALL"),
    ("ALL", "ALL"),
    ("pre_packaged_food", "Food & Beverages"),
    ("e_commerce_listing", "E-Commerce"),
    ("cosmetics", "Cosmetics"),
    ("medical_devices", "Medical Devices"),
    ("pharma_price_controlled", "Pharmaceuticals"),
    ("garments_hosiery", "Garments & Hosiery"),
    ("pan_masala", "Pan Masala"),
    ("bulk_over_25kg", "Bulk Packages"),
    ("farm_produce", "Farm Produce"),
    ("industrial_institutional", "Institutional Consumer"),
    ("combination_group_package", "Group Packages"),
    ("imported_products", "Imported Products"),
]

# Field -> synonyms that may carry its value, best first
FIELD_ALIASES = {
    "product_name": ["generic_name", "commodity_name", "common_generic_name", "title"],
    "generic_name": ["product_name", "commodity_name", "common_generic_name"],
    "common_generic_name": ["product_name", "generic_name", "commodity_name", "title"],
    "mrp": ["price", "maximum_retail_price", "retail_price", "retail_sale_price"],
    "retail_sale_price": ["mrp", "price", "maximum_retail_price"],
    "mrp_declaration": ["mrp", "price", "maximum_retail_price"],
    "mrp_inclusive_tax": ["tax_inclusive", "inclusive_tax", "tax_clause", "mrp_label_format"],
    "mrp_label_format": ["mrp_inclusive_tax", "tax_inclusive", "inclusive_tax", "tax_clause", "mrp"],
    "mrp_rounding": ["mrp", "price"],
    "net_quantity": ["quantity", "net_weight", "net_content", "net_qty", "net_quantity_numeral"],
    "net_quantity_numeral": ["net_quantity", "quantity", "net_weight"],
    "net_quantity_unit": ["unit_of_measurement", "unit", "uom"],
    "unit_of_measurement": ["net_quantity_unit", "unit", "uom"],
    "manufacturing_date": ["manufacture_pack_import_date", "mfg_date", "mfd", "pkd",
                           "packed_on_date", "date_of_mfg", "month_year_of_manufacture"],
    "manufacture_pack_import_date": ["manufacturing_date", "mfg_date", "mfd", "pkd",
                                     "packed_on_date", "date_of_mfg"],
    "month_year_of_manufacture": ["manufacturing_date", "mfg_date", "mfd", "pkd"],
    "expiry_date": ["best_before_use_by", "exp_date", "use_by", "best_before", "expiration_date"],
    "best_before_use_by": ["expiry_date", "exp_date", "use_by", "best_before", "expiration_date"],
    "best_before": ["expiry_date", "best_before_use_by", "use_by"],
    "batch_number": ["batch_no", "lot_number", "lot_no", "b_no"],
    "manufacturer": ["manufacturer_or_importer_name_address", "packer", "marketer", "importer",
                     "manufacturer_details"],
    "manufacturer_or_importer_name_address": ["manufacturer", "packer", "marketer", "importer",
                                              "manufacturer_details", "address",
                                              "manufacturer_address"],
    "packer": ["manufacturer", "manufacturer_or_importer_name_address"],
    "address": ["manufacturer_address", "packer_address", "factory_address",
                "manufacturer_or_importer_name_address"],
    "consumer_care": ["customer_care", "helpline", "consumer_care_details", "care"],
    "customer_care": ["consumer_care", "helpline", "consumer_care_details", "care"],
    "fssai_license": ["fssai", "license_number", "lic_no", "fssai_lic"],
    "fssai": ["fssai_license", "license_number", "lic_no"],
    "allergen_declaration": ["allergen", "allergen_info", "allergens"],
    "country_of_origin": ["origin_country", "made_in", "ecommerce_coo_filter"],
    "ecommerce_coo_filter": ["country_of_origin", "origin_country", "made_in"],
    "unit_sale_price": ["usp", "unit_price"],
    "usp": ["unit_sale_price", "unit_price"],
    "voluntary_marks": ["barcode", "gtin", "qr_code"],
    "quantity_by_number_wording": ["net_quantity_unit", "unit_of_measurement", "quantity"],
    "ingredients": ["ingredient_list", "list_of_ingredients", "ingredients_list", "ingredient"],
    "ingredient_list": ["ingredients", "list_of_ingredients", "ingredients_list", "ingredient"],
}
# Which fields may borrow a derived value
UNIT_FIELDS = ["unit_of_measurement", "net_quantity_unit", "unit", "uom"]
TAX_FIELDS = ["mrp_inclusive_tax", "tax_inclusive", "inclusive_tax", "tax_clause"]
UNIT_PRICE_FIELDS = ["unit_sale_price", "usp", "unit_price"]

# Report-time field -> single declaration that explains it
EXPLAIN_ALIASES = {
    "retail_sale_price": "mrp",
    "mrp_declaration": "mrp",
    "price": "mrp",
    "mrp_inclusive_tax": "mrp_inclusive_tax",
    "mrp_label_format": "mrp",
    "mrp_rounding": "mrp",
    "net_quantity_numeral": "net_quantity",
    "net_weight": "net_quantity",
    "quantity": "net_quantity",
    "unit_of_measurement": "net_quantity_unit",
    "quantity_by_number_wording": "net_quantity",
    "manufacturer_or_importer_name_address": "manufacturer",
    "packer": "manufacturer",
    "marketer": "manufacturer",
    "month_year_of_manufacture": "manufacturing_date",
    "date_of_manufacture": "manufacturing_date",
    "manufacture_pack_import_date": "manufacturing_date",
    "packing_date": "manufacturing_date",
    "best_before": "expiry_date",
    "best_before_use_by": "expiry_date",
    "use_by": "expiry_date",
    "customer_care": "consumer_care",
    "consumer_care_details": "consumer_care",
    "fssai": "fssai_license",
    "fssai_lic": "fssai_license",
    "product_name": "generic_name",
    "common_generic_name": "generic_name",
    "commodity_name": "generic_name",
    "ingredients": "ingredient_list",
    "ingredient_list": "ingredients",
}
# Fields whose box may stand in, best first
BOX_FALLBACKS = {
    "unit_of_measurement": ["net_quantity", "net_quantity_unit"],
    "net_quantity_unit": ["net_quantity"],
    "net_quantity": ["net_quantity_unit"],
    "quantity_by_number_wording": ["net_quantity"],
    "mrp_inclusive_tax": ["mrp"],
    "mrp_label_format": ["mrp"],
    "mrp_rounding": ["mrp"],
    "common_generic_name": ["generic_name", "product_name"],
    "product_name": ["generic_name"],
    "generic_name": ["product_name"],
    "manufacturer_or_importer_name_address": ["manufacturer"],
    "manufacture_pack_import_date": ["manufacturing_date"],
    "best_before_use_by": ["expiry_date"],
    "ingredients": ["ingredient_list"],
    "ingredient_list": ["ingredients"],
}

# Keys every scan session carries
SESSION_FIELDS = [
    "mrp", "mrp_inclusive_tax", "net_quantity", "unit_of_measurement",
    "unit_sale_price", "manufacturing_date", "expiry_date", "batch_number",
    "manufacturer", "packer", "marketer", "importer", "country_of_origin",
    "consumer_care", "consumer_care_phone", "consumer_care_email",
    "generic_name", "fssai_license",
]
EXTRACTION_RATE_FIELDS = [
    "generic_name", "manufacturer", "mrp", "net_quantity",
    "manufacturing_date", "consumer_care",
]
CHECKLIST_FIELDS = ["mrp", "net_quantity", "manufacturing_date", "expiry_date", "customer_care"]
EXPECTED_FIELDS = [
    "generic_name", "net_quantity", "mrp", "manufacturing_date", "expiry_date",
    "batch_number", "manufacturer", "consumer_care", "country_of_origin",
]

# --------------------------------------------------------------------------
# Category inference terms
# --------------------------------------------------------------------------
FOOD_TERMS = ["BISCUIT", "COOKIE", "CHIPS", "NOODLE", "SNACK", "FLOUR", "ATTA", "OIL", "MILK",
              "CHOCOLATE", "TEA", "COFFEE", "RICE", "SUGAR"]
COSMETIC_TERMS = ["CREAM", "LOTION", "SHAMPOO", "SOAP", "SERUM", "PERFUME", "LIPSTICK",
                  "DEODORANT"]
PHARMA_TERMS = ["TABLET", "CAPSULE", "SYRUP", "OINTMENT", "INJECTION", "IP", "BP", "USP"]

# --------------------------------------------------------------------------
# Text screens
# --------------------------------------------------------------------------
GENERIC_NAME_PHRASES = [
    "powder form", "in powder form", "powderform", "inpowderform",
    "export quality", "proprietary food", "nutrition information",
    "nutritional information", "nutritional facts", "nutrition facts",
    "serving size", "store in cool", "keep in cool", "dry place",
    "hygienically packed", "100% natural", "ingredient", "ingredients",
    "contains", "samagri", "ghatak",
]
GENERIC_NAME_HEADERS = ["BATCH", "LOT", "B.NO", "L.NO", "MFD", "MFG", "PKD", "EXP", "MRP",
                        "USE BY"]
INGREDIENT_PHRASES = [
    "powder form", "in powder form", "powderform", "inpowderform", "paste",
    "paste form", "granules", "liquid form", "solid form", "whole form",
    "form: powder form", "form: powder", "form powder", "export quality",
    "proprietary food", "store in cool", "keep in cool", "dry place",
    "hygienically packed", "100% natural",
]
PLACEHOLDER_PHRASES = ["lorem ipsum", "asdf", "qwerty", "test product", "sample brand",
                       "xxgfchf", "xxxx", "test brand"]
STOP_WORDS = ["USEBY", "USE", "BY", "PKD", "MFD", "MFG", "MRP", "NET", "WEIGHT", "BATCH", "LOT",
              "EXP", "EXPIRY", "BEST", "BEFORE", "INCL", "TAXES"]
TITLE_SKIP = ["MRP", "MFD", "MFG", "PKD", "PACKED", "EXP", "USE BY", "BEST BEFORE", "BATCH",
              "LOT", "NET WT", "NET WEIGHT", "FSSAI", "LIC", "CUSTOMER", "CARE", "CIN:", "TEL:",
              "EMAIL:", "WWW.", "INGREDIENT", "INCL"]
PLAIN_LINE_SKIP = ["MRP", "MFD", "MFG", "PKD", "PACKED", "EXP", "USE BY", "BATCH", "LOT",
                   "NET WT", "NET WEIGHT", "FSSAI", "CUSTOMER", "CONSUMER", "INGREDIENT", "CIN:",
                   "TEL:", "EMAIL:", "WWW.", "LIC."]
SINGLE_COMMODITIES = ["TURMERIC", "TURMERIC POWDER", "HALDI", "CHILLI", "CHILLI POWDER",
                      "CORIANDER", "CORIANDER POWDER", "CUMIN", "JEERA", "BLACK PEPPER",
                      "PEPPER", "SALT", "IODISED SALT", "SUGAR", "WHEAT FLOUR", "ATTA", "MAIDA",
                      "RICE", "MUSTARD", "MUSTARD SEEDS"]
MAKER_ROW_SKIP = ["CIN", "GST", "PAN", "FSSAI", "LIC", "TEL", "EMAIL", "WWW"]
DEFAULT_TITLES = ["packaged commodity item", "packaged commodity", "item",
                  "unidentified packaging label", "unidentified product label", "product"]
DEFAULT_TITLE = "Packaged Commodity Item"

# --------------------------------------------------------------------------
# units
# --------------------------------------------------------------------------
# spelling -> (shown unit, base unit, multiplier)
UNITS = {
    "g": ("g", "g", 1.0), "gm": ("g", "g", 1.0), "gms": ("g", "g", 1.0),
    "gram": ("g", "g", 1.0), "grams": ("g", "g", 1.0),
    "kg": ("kg", "g", 1000.0), "kgs": ("kg", "g", 1000.0),
    "kilogram": ("kg", "g", 1000.0), "kilograms": ("kg", "g", 1000.0),
    "mg": ("mg", "g", 0.001), "milligram": ("mg", "g", 0.001), "milligrams": ("mg", "g", 0.001),
    "ml": ("ml", "ml", 1.0), "mls": ("ml", "ml", 1.0),
    "millilitre": ("ml", "ml", 1.0), "millilitres": ("ml", "ml", 1.0),
    "milliliter": ("ml", "ml", 1.0), "milliliters": ("ml", "ml", 1.0),
    "l": ("L", "ml", 1000.0), "ltr": ("L", "ml", 1000.0),
    "litre": ("L", "ml", 1000.0), "litres": ("L", "ml", 1000.0),
    "liter": ("L", "ml", 1000.0), "liters": ("L", "ml", 1000.0),
    "cl": ("cl", "ml", 10.0),
    "m": ("m", "m", 1.0), "meter": ("m", "m", 1.0), "meters": ("m", "m", 1.0),
    "metre": ("m", "m", 1.0), "metres": ("m", "m", 1.0),
    "cm": ("cm", "m", 0.01), "centimeter": ("cm", "m", 0.01), "centimeters": ("cm", "m", 0.01),
    "mm": ("mm", "m", 0.001),
    "sq.m": ("sq.m", "sq.m", 1.0), "sq.cm": ("sq.cm", "sq.m", 0.0001),
    "u": ("N", "N", 1.0), "unit": ("N", "N", 1.0), "units": ("N", "N", 1.0),
    "n": ("N", "N", 1.0), "piece": ("N", "N", 1.0), "pieces": ("N", "N", 1.0),
    "pc": ("N", "N", 1.0), "pcs": ("N", "N", 1.0), "count": ("N", "N", 1.0),
    "pack": ("N", "N", 1.0), "tablets": ("N", "N", 1.0), "capsules": ("N", "N", 1.0),
}
# spelling -> canonical unit used when a single value is normalised
UNIT_SPELLINGS = {
    "gm": "g", "gms": "g", "gram": "g", "grams": "g", "g": "g",
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg",
    "mg": "mg", "milligram": "mg", "milligrams": "mg",
    "ml": "ml", "millilitre": "ml", "millilitres": "ml", "milliliter": "ml", "milliliters": "ml",
    "l": "l", "ltr": "l", "litre": "l", "litres": "l", "liter": "l", "liters": "l",
    "n": "n", "count": "count", "units": "u", "unit": "u", "u": "u",
    "tablets": "tablets", "tablet": "tablets", "capsules": "capsules", "capsule": "capsules",
    "piece": "piece", "pieces": "piece", "pc": "piece", "pcs": "piece",
}
LEGAL_UNITS = ["g", "kg", "mg", "ml", "l", "m", "cm", "mm", "sq.m", "n", "u"]
STANDARD_SIZES = [50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0]

# --------------------------------------------------------------------------
# Brackets, each (lower bound exclusive, upper bound inclusive, ...)
# --------------------------------------------------------------------------
LETTER_HEIGHTS = [  # panel area -> printed mm, raised mm
    (None, 50.0, 1.0, 1.5),
    (50.0, 100.0, 1.5, 2.0),
    (100.0, 500.0, 2.5, 4.0),
    (500.0, 2500.0, 4.0, 6.0),
    (2500.0, None, 6.0, 6.0),
]
PANEL_MIN_HEIGHTS = [  # panel area -> mm, geometry variant
    (None, 50.0, 1.5),
    (50.0, 200.0, 2.0),
    (200.0, 1000.0, 4.0),
    (1000.0, None, 6.0),
]
TOLERANCES = [  # quantity in g or ml -> error, kind
    (None, 50.0, 9.0, "percent"),
    (50.0, 100.0, 4.5, "fixed_g"),
    (100.0, 200.0, 4.5, "percent"),
    (200.0, 500.0, 3.0, "percent"),
    (500.0, 1000.0, 15.0, "fixed_g"),
    (1000.0, None, 1.5, "percent"),
]
DISPLAY_TOLERANCES = [  # quantity in g or ml -> error, kind (display variant)
    (None, 50.0, 9.0, "percent"),
    (50.0, 100.0, 4.5, "fixed"),
    (100.0, 200.0, 4.5, "percent"),
    (200.0, 300.0, 9.0, "fixed"),
    (300.0, 500.0, 3.0, "percent"),
    (500.0, 1000.0, 15.0, "fixed"),
    (1000.0, None, 1.5, "percent"),
]
RAISED_PRINTS = ["embossed", "blown", "moulded"]

# --------------------------------------------------------------------------
# Names, regions, languages
# --------------------------------------------------------------------------
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_NAMES = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST",
               "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
REGION_LABELS = {
    "text": "statutory_block", "paragraphs": "statutory_block", "paragraph": "statutory_block",
    "label_region": "statutory_block", "label": "statutory_block",
    "mrp_block": "mrp_block", "mrp": "mrp_block", "price": "mrp_block",
    "dates_block": "dates_block", "date": "dates_block", "expiry": "dates_block",
    "mfg": "dates_block",
    "fssai_logo": "fssai_logo", "fssai_block": "fssai_block", "fssai": "fssai_block",
    "ingredient_block": "ingredient_block", "ingredients": "ingredient_block",
    "net_quantity_block": "net_quantity_block", "net_weight": "net_quantity_block",
    "quantity": "net_quantity_block",
    "nutrition_block": "nutrition_block", "nutrition": "nutrition_block",
    "barcode_block": "barcode_block", "barcode": "barcode_block", "qr_code": "barcode_block",
    "package": "package",
}
DEFAULT_REGION = "statutory_block"
LANGUAGES = {
    "devanagari": "devanagari", "hindi": "devanagari", "hi": "devanagari",
    "sanskrit": "devanagari", "sa": "devanagari", "marathi": "devanagari", "mr": "devanagari",
    "tamil": "ta", "ta": "ta", "telugu": "te", "te": "te", "kannada": "ka", "ka": "ka",
    "malayalam": "ml", "ml": "ml", "odia": "or", "oriya": "or", "or": "or",
    "english": "en", "en": "en",
}
DEFAULT_LANGUAGE = "devanagari"
# first digit of each script: Devanagari, Tamil, Telugu, Kannada, Malayalam,
# Odia, Bengali, Gurmukhi, Gujarati
INDIC_ZEROES = [0x0966, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0B66, 0x09E6, 0x0A66, 0x0AE6]

FIELD_LABELS = {
    "mrp": "Maximum Retail Price (MRP)",
    "mrp_inclusive_tax": "MRP — Tax Inclusion Clause",
    "mrp_label_format": "MRP Label Format",
    "mrp_rounding": "MRP Rounding Compliance",
    "net_quantity": "Net Quantity Declaration",
    "net_quantity_unit": "Net Quantity — SI Unit",
    "unit_of_measurement": "Unit of Measurement",
    "quantity_by_number_wording": "Quantity by Count / Wording",
    "manufacturer": "Manufacturer / Packer Address",
    "manufacturer_or_importer_name_address": "Manufacturer / Importer Name & Address",
    "manufacturing_date": "Manufacturing / Packing Date",
    "month_year_of_manufacture": "Month-Year of Manufacture",
    "expiry_date": "Expiry / Best Before Date",
    "best_before_use_by": "Best Before / Use By Date",
    "consumer_care": "Consumer Care Details",
    "customer_care": "Customer Care Contact",
    "fssai_license": "FSSAI License Number",
    "generic_name": "Generic / Common Name",
    "common_generic_name": "Common Generic Name",
    "ingredients": "Ingredient List",
    "ingredient_list": "Ingredient List",
    "country_of_origin": "Country of Origin",
    "batch_number": "Batch / Lot Number",
    "barcode": "Barcode / EAN",
    "nutrition_declaration": "Nutrition Information",
}

# --------------------------------------------------------------------------
# People and audit
# --------------------------------------------------------------------------
ROLES = ["admin", "inspector", "reviewing_officer"]
AUDIT_GROUPS = {
    "INSPECTIONS": ["INSPECTION_SCAN_PROCESSED", "VERIFY_INSPECTION"],
    "RULES": ["UPDATE_RULE", "CREATE_RULE", "DELETE_RULE", "RULE_VERSION_UPDATE"],
    "USERS": ["CREATE_USER", "UPDATE_USER_ROLE"],
    "DISPATCH": ["WORK_ASSIGNED"],
}
COMPLIANT_WORDS = ["COMPLIANT", "PASS", "TRUE", "7A COMPLIANT", "VALID", "1"]

# --------------------------------------------------------------------------
# Live frames
# --------------------------------------------------------------------------
MIN_SHARPNESS = 55.0
MAX_MOTION = 8.5
