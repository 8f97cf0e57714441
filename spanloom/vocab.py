"""Closed vocabularies of the annotation model.  Fixed values: results depend on them letter by letter."""

TYPES = ("THUỐC", "CHẨN_ĐOÁN", "TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM")
DRUG, DIAGNOSIS, SYMPTOM, LAB_NAME, LAB_RESULT = TYPES
CODED_TYPES = (DIAGNOSIS, DRUG)
ASSERTIONS = ("isNegated", "isHistorical", "isFamily")
CONTEXT_LEN = 15

BANNED_EXACT = (
    "xét nghiệm", "các xét nghiệm", "chẩn đoán hình ảnh", "cận lâm sàng", "thăm khám", "kiểm tra", "xét nghiệm máu", "chụp chiếu",
    "huyết áp", "ha", "mạch", "nhiệt độ", "nhịp thở", "nhịp tim", "spo2", "cân nặng", "chiều cao", "bmi",
)
VITAL_VALUE = r"(?iu)^\s*\d{1,3}([.,]\d+)?\s*(/\s*\d{1,3})?\s*(mmhg|l/p|lần/phút|lan/phut|độ\s*c|do\s*c|kg|cm)\s*$"
ONE_SYLLABLE = ("đau", "yếu", "phù", "ho", "sốt", "nôn", "mệt", "sưng", "ngứa", "rát", "tê")
MASK = r"\*{3,}"

TYPE_LETTER = {DRUG: "M", DIAGNOSIS: "D", SYMPTOM: "T", LAB_NAME: "X", LAB_RESULT: "K"}
ASSERTION_LETTER = {"isNegated": "N", "isHistorical": "H", "isFamily": "F"}

HISTORY_SECTIONS = ("tiền sử bệnh", "tiền sử bệnh nội khoa", "tiền sử bệnh lý", "tiền sử bệnh nội")
PRESENT_SECTIONS = ("tiền sử bệnh hiện tại", "bệnh sử hiện tại", "bệnh sử", "lịch sử bệnh hiện tại", "tiền sử bệnh bệnh hiện tại")
HISTORICAL_SUBS = (
    "thuốc trước khi nhập viện", "thuốc trước khi nhập viện lần này", "bệnh lý mãn tính", "các bệnh lý mãn tính", "các bệnh mãn tính",
    "bệnh mãn tính", "bệnh mạn tính", "tiền sử phẫu thuật / thủ thuật", "các yếu tố nguy cơ liên quan", "các đợt tương tự trước đây",
    "các sự kiện trước khi nhập viện", "sự kiện trước khi nhập viện", "trước khi nhập viện", "các diễn biến  trước khi nhập viện",
)
SKIPPED_SUBS = (
    "tiền sử phẫu thuật / thủ thuật", "lịch sử phẫu thuật / thủ thuật", "các thủ thuật đã thực hiện", "các thủ thuật thực hiện",
    "thủ thuật thực hiện", "các thủ thuật", "kết quả chẩn đoán hình ảnh", "kết quả chụp ảnh", "kết quả chụp ảnh / tạo ảnh",
    "kết quả xét nghiệm", "kết quả phòng thí nghiệm", "cận lâm sàng", "siêu âm tim", "nhiệt độ", "thời điểm khởi phát triệu chứng",
    "thời điểm khởi phát", "mức độ nghiêm trọng", "vị trí", "tần suất", "hoàn cảnh khởi phát", "các yếu tố làm nặng",
    "yếu tố làm nặng", "các yếu tố làm giảm",
)
SUBHEADER_PREFIXES = (
    "thuốc trước khi nhập viện", "triệu chứng hiện tại", "các triệu chứng hiện tại", "bệnh lý mãn tính", "các bệnh lý mãn tính",
    "các bệnh mãn tính", "bệnh mãn tính", "bệnh mạn tính", "các bệnh mạn tính", "các yếu tố nguy cơ", "yếu tố nguy cơ",
    "tiền sử phẫu thuật", "lịch sử phẫu thuật", "các thủ thuật", "thủ thuật", "các phát hiện chẩn đoán", "các kết quả chẩn đoán",
    "kết quả chẩn đoán hình ảnh", "kết quả xét nghiệm", "kết quả khám", "kết quả phòng thí nghiệm", "cận lâm sàng",
    "các sự kiện trước khi nhập viện", "sự kiện trước khi nhập viện", "các diễn biến", "diễn biến", "các đợt tương tự",
    "đặc điểm triệu chứng", "lý do nhập viện", "thời điểm khởi phát", "tình trạng ngay trước khi nhập viện", "mức độ nghiêm trọng",
    "vị trí", "tần suất", "hoàn cảnh khởi phát", "các yếu tố làm", "dấu hiệu lâm sàng", "điều trị", "chẩn đoán", "tiền sử",
)

CUES = {
    "isNegated": ("không có", "không ghi nhận", "không thấy", "không còn", "phủ nhận", "âm tính", "loại trừ", "chưa ghi nhận", "chưa có", "không bị", "không đau", "không sốt"),
    "isHistorical": (
        "tiền sử", "trước đây", "trước khi nhập viện", "đã từng", "nhiều năm", "năm trước", "tháng trước", "ngày trước", "cách đây",
        "từ nhỏ", "mãn tính", "mạn tính", "trong quá khứ", "đã được chẩn đoán",
    ),
    "isUncertain": ("nghi ngờ", "có thể", "khả năng", "theo dõi", "chưa loại trừ", "nghĩ nhiều đến", "có lẽ", "chẩn đoán phân biệt", "?"),
    "isFamily": (
        "gia đình", "mẹ", "bố", "cha", "anh trai", "chị gái", "em trai", "em gái", "con trai", "con gái", "người thân", "ông", "bà",
        "tiền sử gia đình", "chồng", "vợ", "anh em", "họ hàng",
    ),
    "isHypothetical": ("nếu", "trong trường hợp", "khi cần", "dặn dò", "hướng dẫn", "dị ứng"),
}
NOT_NEGATION = (
    "không đặc hiệu", "không xác định", "không do chấn thương", "không tự chủ", "không biến chứng", "không rõ nguyên nhân",
    "không hồi phục", "không ổn định", "không dung nạp",
)
TERMINATOR = r"(?U)[.;]|\bnhưng\b|\btuy nhiên\b|\bmặc dù\b"
CUE_GAP = 60

SALTS = (
    "sodium", "hydrochloride", "hcl", "calcium", "potassium", "sulfate", "sulphate", "tartrate", "bitartrate", "succinate", "maleate",
    "besylate", "mesylate", "citrate", "acetate", "phosphate", "fumarate", "hydrobromide", "bromide", "nitrate", "chloride",
    "gluconate", "carbonate", "lactate", "oxalate", "pamoate", "palmitate", "propionate", "valerate", "dipropionate", "mofetil",
)
STRENGTH = r"(\d+(?:\.\d+)?)\s*(MG/ML|MCG/ML|MG/HR|MG|MCG|ML|G|UNT|%|MEQ|MMOL)\b"
DOSE = r"(\d+(?:\.\d+)?)(?:\s*-\s*\d+(?:\.\d+)?)?\s*(mg|mcg|g|ml|units?|đơn vị|iu)\b"
ROUTE = r"\b(po|iv|im|sc|sl|pr|uống|tiêm|khí dung|tĩnh mạch)\b"
FREQUENCY = r"\b(bid|tid|qid|qd|qhs|qam|qpm|prn|q\d+h(?::prn)?|daily|hàng ngày|mỗi ngày|x\s*\d+)\b"
INDICATION = r"\b(cho|điều trị|để|vì|do)\b"
EXTENDED_RELEASE = r"\b(xl|xr|er|sr|cr|la|extended release|giải phóng kéo dài|phóng thích chậm)\b"
ROUTE_FORM = {
    "po": "oral tablet", "uống": "oral tablet", "oral": "oral tablet", "iv": "injection", "tĩnh mạch": "injection", "im": "injection",
    "sc": "injection", "tiêm": "injection", "sl": "sublingual tablet", "khí dung": "inhalation solution",
}
DRUG_TAIL = (
    r"^(?:[\d.,/:%\-()+xX]+|mg|mcg|ml|g|gram|units?|unt|iu|đơn|vị|po|iv|sc|im|pr|sl|neb|inh|oral|uống|tiêm|bid|tid|qid|daily|qd|qhs|qam|q\d+h|prn|"
    r"xl|er|sr|cr|la|xr|tab|cap|viên|gói|ống)$"
)
NO_DRUG = r"ngộ độc|dị ứng|quá liều|phản ứng|tác dụng phụ|lệ thuộc|nghiện"
STOP_DRUGS = (
    "water", "oxygen", "air", "alcohol", "sodium", "calcium", "iron", "potassium", "magnesium", "nitrogen", "carbon", "coal", "gold",
    "silver", "tin", "lead", "zinc", "copper", "soap", "honey", "milk", "sugar", "salt", "starch", "protein", "oil", "wax", "gas", "ice",
    "tea", "coffee", "cocoa", "lemon", "orange", "apple", "banana", "onion", "garlic", "ginger", "pepper", "mint", "history", "date",
    "test", "type", "from", "dose", "gram", "pound", "phase",
)
LAB_ANALYTES = (
    "creatinine", "guaiac", "caffeine", "bilirubin", "troponin", "albumin", "hemoglobin", "ferritin", "urea", "ammonia", "cholesterol",
    "triglyceride", "lactate", "glucose", "lipase", "amylase", "digoxin", "ethanol", "cortisol", "thyroxine", "creatine", "myoglobin",
    "fibrinogen", "haptoglobin", "transferrin",
)
