"""The term lists of the default configuration. They are bags: a term that stands twice counts twice."""

# Every list below must hold just these terms for right results.

HARD_NEGATIVE = [
    "bank", "banking", "loan", "credit card", "insurance", "pest control", "exterminator", "termite", "water leaks", "leak detection", "leak repair",
    "plumbing leak", "cleaning services", "house cleaning", "general cleaning", "car", "cars", "auto", "automotive", "dealership", "car dealer",
    "travel", "hotels", "flight booking", "ticketing", "food delivery", "restaurant delivery", "real estate listings", "property listings",
    "classifieds", "riyadbank", "riyadh bank", "ورشة سيارات", "صيانة سيارات", "مستشفى", "عيادة", "بنك", "قرض", "بطاقة", "تأمين", "مكافحة حشرات",
    "نمل", "صراصير", "كشف تسرب", "تسربات المياه", "تسربات", "كشف تسريب", "تنظيف", "شركة تنظيف", "مغاسل", "غسيل", "سيارات", "معرض سيارات",
    "بيع سيارات", "سفر", "حجوزات", "طيران", "تذاكر", "توصيل الطعام", "طلبات الطعام", "عقار", "عقارات", "إعلانات عقارية",
]

CITIES = [
    "riyadh", "jeddah", "dammam", "khobar", "al khobar", "makkah", "mecca", "medina", "madinah", "taif", "tabuk", "abha", "jizan", "najran", "jubail",
    "yanbu", "hail", "buraydah", "qassim", "al ahsa", "hofuf", "الرياض", "جدة", "الدمام", "الخبر", "مكة", "مكة المكرمة", "المدينة", "المدينة المنورة",
    "الطائف", "تبوك", "أبها", "جيزان", "نجران", "الجبيل", "ينبع", "حائل", "بريدة", "القصيم", "الأحساء", "الاحساء", "الهفوف",
]

SERVICE_EVIDENCE = [
    "fit-out", "fit out", "fitout", "interior fit-out", "interior finishing", "contracting", "contractor", "general contractor", "turnkey",
    "engineering", "engineering consultancy", "engineering office", "architect", "architectural design", "design office", "interior works", "تشطيب",
    "مقاولات", "مقاول", "تسليم مفتاح", "فيت اوت", "مكتب هندسي", "استشارات هندسية", "تصميم معماري", "مقاول عام", "مقاولات عامة", "مقاولات بناء",
    "مقاولات إنشائية", "تصميم داخلي", "تصميم داخلي معماري", "ديكور", "أعمال ديكور", "تشطيبات", "تشطيبات داخلية", "أعمال تشطيب", "تنفيذ داخلي",
    "تجهيز داخلي", "اعمال داخلية", "أعمال داخلية", "أعمال معمارية", "إشراف هندسي", "إدارة مشاريع", "إدارة مشروع", "إدارة تنفيذ", "مكتب استشاري",
    "استشاري هندسي", "مكتب تصميم", "تصميم هندسي", "اعمال انشائية", "أعمال إنشائية", "مقاول بناء",
]

DEVELOPER_EVIDENCE = [
    "real estate developer", "property developer", "master developer", "real estate development", "property development", "development company",
    "general contractor", "construction company", "contracting company", "engineering consultancy", "engineering office", "design & build",
    "design-build", "project management", "pmo", "مطوّر عقاري", "مطور عقاري", "تطوير عقاري", "شركة تطوير", "شركة تطوير عقاري", "مقاول عام",
    "مقاولات عامة", "شركة مقاولات", "مكتب هندسي", "استشارات هندسية", "إدارة مشاريع", "ادارة مشاريع", "إدارة المشروع", "ادارة المشروع", "تطوير مشاريع",
]

PROJECT_EVIDENCE = [
    "projects", "our projects", "case studies", "clients", "portfolio", "scope of work", "services", "fit-out", "turnkey", "مشاريع", "مشاريعنا",
    "دراسات حالة", "عملاء", "بورتفوليو", "نطاق العمل", "الخدمات", "الخدمات المقدمة", "تشطيب", "تسليم مفتاح",
]

OFF_VERTICAL = [
    "water leak", "leak detection", "pest control", "cleaning services", "car", "auto", "dealership", "bank", "loan", "insurance", "travel", "hotel",
    "flight", "food delivery", "real estate listings", "property listings", "classifieds", "تسرب", "تسربات", "كشف تسرب", "مكافحة حشرات", "تنظيف",
    "سيارات", "معرض سيارات", "بنك", "قرض", "تأمين", "سفر", "حجز", "توصيل الطعام", "طلبات الطعام", "عقار", "إعلانات",
]

SHOWROOM_PROOF = [
    "open", "hours", "opening hours", "visit", "branches", "branch", "showroom", "معرض", "فروع", "ساعات العمل", "زوروا المعرض",
]

FOREIGN = [
    "uae", "dubai", "abu dhabi", "qatar", "doha", "kuwait", "oman", "bahrain", "egypt", "cairo", "jordan", "amman", "lebanon", "beirut", "iraq",
    "baghdad", "syria", "damascus", "yemen", "sana'a", "sanaa", "morocco", "rabat", "tunisia", "algeria", "libya", "sudan", "turkey", "istanbul",
    "uk", "london", "usa", "new york", "germany", "berlin", "الإمارات", "دبي", "ابوظبي", "أبوظبي", "قطر", "الدوحة", "الكويت", "عمان", "البحرين",
    "مصر", "القاهرة", "الأردن", "عمّان", "لبنان", "بيروت", "العراق", "بغداد", "سوريا", "دمشق", "اليمن", "صنعاء", "المغرب", "الرباط", "تونس",
    "الجزائر", "ليبيا", "السودان",
]

MARKETPLACE_HOSTS = [
    "opensooq", "haraj", "aqar", "bayut", "linkedin", "amazon", "ikea", "tamimimarkets", "noon", "dubizzle", "olx",
]

KITCHEN = [
    "kitchen", "kitchens", "kitchen design", "kitchen installation", "kitchen supplier", "kitchen company", "kitchen showroom", "cabinet", "cabinets",
    "cabinetry", "kitchen cabinets", "wardrobe", "wardrobes", "closet", "closets", "fitted wardrobe", "built-in wardrobe", "walk-in closet",
    "joinery", "woodwork", "carpentry", "millwork", "modular kitchen", "custom kitchen", "custom cabinetry", "countertop", "worktop", "granite",
    "quartz", "marble", "vanity", "vanities", "tv unit", "wall unit", "مطابخ", "مطبخ", "تصميم مطابخ", "تركيب مطابخ", "تنفيذ مطابخ", "شركة مطابخ",
    "معرض مطابخ", "خزائن", "خزانة", "خزائن مطبخ", "دواليب", "دولاب", "غرف ملابس", "غرفة ملابس", "كلوزيت", "ووك إن كلوزيت", "نجارة", "أعمال نجارة",
    "أعمال خشبية", "تفصيل", "مطابخ مودرن", "مطابخ تفصيل", "تفصيل مطابخ", "رخام", "جرانيت", "كوارتز", "سطح", "كونترتوب", "مغاسل", "وحدات حمام",
    "وحدة تلفزيون", "وحدة حائط",
]

INTERIOR = [
    "interior", "interiors", "interior design", "interior designer", "design studio", "design consultancy", "space planning", "decoration", "decor",
    "home decor", "styling", "furniture design", "custom furniture", "bespoke furniture", "residential interior", "commercial interior",
    "تصميم داخلي", "مصمم داخلي", "استشارات تصميم", "استشارات ديكور", "استديو تصميم", "تخطيط المساحات", "توزيع المساحات", "ديكور", "ديكورات",
    "ديكور منزلي", "تنسيق", "تصميم أثاث", "أثاث تفصيل", "تفصيل أثاث", "أثاث حسب الطلب", "تصميم سكني", "تصميم تجاري",
]

FITOUT = [
    "fit-out", "fit out", "fitout", "interior fit-out", "turnkey", "turn key", "turn-key", "turnkey solutions", "interior finishing",
    "construction finishing", "villa finishing", "office fit-out", "commercial fit-out", "renovation", "remodel", "refurbishment", "contracting",
    "contractor", "general contractor", "civil works", "gypsum", "false ceiling", "partition", "mep", "electrical", "plumbing", "hvac", "فيت اوت",
    "فت اوت", "تشطيب", "تشطيبات", "تشطيب داخلي", "تسليم مفتاح", "حلول متكاملة", "تنفيذ متكامل", "ترميم", "تجديد", "إعادة تأهيل", "تعديل", "مقاولات",
    "مقاول", "مقاول عام", "شركة مقاولات", "أعمال مدنية", "جبس", "جبس بورد", "أسقف مستعارة", "قواطع", "مقسمات", "ميكانيكا", "كهرباء", "سباكة", "تكييف",
    "تمديدات", "إشراف", "إدارة مشروع",
]

PORTFOLIO = [
    "portfolio", "projects", "case study", "case studies", "gallery", "project gallery", "before and after", "completed projects", "recent projects",
    "مشاريع", "مشروع", "اعمالنا", "أعمالنا", "نماذج أعمال", "معرض اعمال", "معرض أعمال", "ألبوم", "قبل وبعد", "مشاريع منفذة", "أحدث المشاريع",
]

SHOWROOM = [
    "showroom", "kitchen showroom", "display", "exhibition", "experience center", "store", "shop", "معرض", "صالة عرض", "مركز تجربة", "متجر", "محل",
    "عرض", "معرض مطابخ",
]

DESIGNER = [
    "interior designer", "interior design", "design consultancy", "space planning", "concept design", "moodboard", "مصمم داخلي", "تصميم داخلي",
    "استشارات تصميم", "تخطيط المساحات", "تصميم مفاهيمي", "لوحة إلهام",
]

ARCHITECT = [
    "architect", "architecture", "architectural", "architects", "engineering office", "engineering consultancy", "architectural design",
    "structural design", "site supervision", "permit", "building permit", "معماري", "هندسة معمارية", "تصميم معماري", "مكتب هندسي", "استشارات هندسية",
    "تصميم إنشائي", "هندسة إنشائية", "إشراف", "إشراف هندسي", "رخصة بناء", "تصريح بناء", "مخططات", "مخططات معمارية", "اعتماد مخططات",
]

DEVELOPER = [
    "real estate developer", "property developer", "development company", "real estate development", "projects development", "مطوّر عقاري",
    "مطور عقاري", "تطوير عقاري", "شركة تطوير", "تطوير مشاريع", "تطوير عقاري سكني", "تطوير عقاري تجاري",
]

INDIVIDUAL_MARKERS = [
    "i need", "looking for", "need a", "want to", "can someone", "my villa", "my apartment", "my house", "my kitchen", "budget", "price", "how much",
    "cost", "whatsapp me", "call me", "dm me", "contact me", "احتاج", "أحتاج", "ابحث عن", "أبحث عن", "محتاج", "اريد", "أريد", "بيتي", "شقتي", "فيلا",
    "مطبخي", "مطبخ", "ميزانية", "سعر", "اسعار", "تكلفة", "كم السعر", "كم يكلف", "واتساب", "راسلني", "اتصل علي", "كلموني", "رسالة خاصة",
]

BUSINESS_MARKERS = [
    "llc", "ltd", "company", "co.", "corp", "inc", "contracting", "contractor", "trading", "factory", "manufacturer", "since", "est.", "established",
    "branches", "head office", "commercial", "b2b", "profile", "company profile", "iso", "vat", "cr number", "registration", "شركة", "مؤسسة",
    "مجموعة", "مصنع", "شركة تصنيع", "مقاول", "مقاولات", "شركة مقاولات", "مقاول عام", "تجارة", "تجارية", "توريد", "تأسست", "تأسيس", "منذ", "فرع",
    "فروع", "المقر الرئيسي", "سجل تجاري", "رقم السجل", "رقم ضريبي", "الرقم الضريبي", "بروفايل", "ملف الشركة", "شهادة", "ايزو", "مكتب هندسي",
    "استشارات هندسية",
]

HIGH_PRECISION = [
    "kitchen showroom", "kitchen installation", "modular kitchen", "custom cabinetry", "kitchen cabinets", "interior fit-out", "fit out contractor",
    "turnkey fit-out", "turnkey solutions", "villa finishing", "office fit-out", "commercial fit-out", "joinery", "bespoke furniture", "معرض مطابخ",
    "تفصيل مطابخ", "تركيب مطابخ", "فيت اوت", "تشطيب داخلي", "تسليم مفتاح", "شركة مقاولات", "مقاول تشطيبات",
]

MID_PRECISION = [
    "kitchen", "cabinet", "cabinetry", "wardrobe", "closet", "walk-in closet", "interior", "interior design", "renovation", "refurbishment",
    "contractor", "showroom", "projects", "portfolio", "fitout", "finishing", "مطابخ", "خزائن", "دواليب", "غرف ملابس", "تصميم داخلي", "ديكور",
    "ترميم", "تجديد", "مقاولات", "تشطيب", "مشاريع", "أعمالنا", "معرض",
]

BUSINESS_INTENT = [
    "services", "our services", "service", "request a quote", "get a quote", "contact us", "our projects", "completed projects", "portfolio",
    "case studies", "company profile", "branches", "head office", "factory", "manufacturer", "خدمات", "اطلب عرض سعر", "عرض سعر", "اتصل بنا",
    "تواصل معنا", "أعمالنا", "مشاريع", "ملف الشركة", "بروفايل", "فروع", "المقر الرئيسي",
]

NEGATIVE = [
    "car repair", "automotive", "garage", "tyres", "tire", "car dealership", "used cars", "restaurant", "cafe", "bakery", "catering", "hospital",
    "clinic", "dentist", "pharmacy", "hotel", "booking", "travel agency", "tourism", "food delivery", "delivery app", "restaurant delivery",
    "real estate listing", "property listing", "classifieds", "marketplace", "crypto", "forex", "bitcoin", "trading platform", "used cars",
    "car dealer", "hair salon", "barber", "spa", "bank", "banking", "loan", "credit card", "insurance", "pest control", "exterminator", "termite",
    "cement", "concrete", "steel", "rebar", "asphalt", "ورشة سيارات", "صيانة سيارات", "ميكانيكا", "كهرباء سيارات", "إطارات", "معرض سيارات", "مطعم",
    "كافيه", "مقهى", "مخبز", "تموين", "مستشفى", "عيادة", "طبيب أسنان", "صيدلية", "فندق", "حجز", "سفر", "وكالة سفر", "سياحة", "توصيل الطعام",
    "تطبيق توصيل", "طلبات طعام", "عقارات", "إعلانات عقارية", "منصة إعلانات", "عملات رقمية", "تداول", "فوركس", "بيتكوين", "منصة تداول",
    "سيارات مستعملة", "معرض سيارات", "صالون", "حلاق", "سبا", "بنك", "قرض", "بطاقة", "تأمين", "مكافحة حشرات", "رش", "نمل", "صراصير", "اسمنت", "خرسانة",
    "حديد", "قضبان",
]

LINK_CONTACT = [
    "contact", "contacts", "get-in-touch", "call-us", "اتصل", "إتصل", "اتصل بنا", "تواصل", "تواصل معنا", "للتواصل",
]

LINK_ABOUT = [
    "about", "about-us", "who-we-are", "company", "profile", "our-story", "من نحن", "نبذة", "نبذة عنا", "عن", "تعريف", "ملف الشركة",
]

LINK_SERVICES = [
    "services", "service", "solutions", "what-we-do", "خدمات", "خدماتنا", "حلول", "مجالات",
]

LINK_PROJECTS = [
    "projects", "project", "portfolio", "gallery", "our-work", "work", "مشاريع", "مشروع", "اعمالنا", "أعمالنا", "معرض", "صور", "ألبوم",
]

QUERY_CITIES = [
    "Riyadh", "Jeddah", "Dammam", "Khobar", "Makkah", "Madinah",
]

QUERY_KITCHEN_EN = [
    "kitchen cabinets", "kitchen showroom", "modular kitchen", "custom kitchen", "kitchen installation", "wardrobes", "walk-in closet",
]

QUERY_KITCHEN_AR = [
    "مطابخ", "تفصيل مطابخ", "تركيب مطابخ", "خزائن مطبخ", "غرف ملابس", "دواليب",
]

QUERY_FITOUT_EN = [
    "fit out contractor", "interior fit out", "turnkey interior", "interior finishing contractor",
]

QUERY_FITOUT_AR = [
    "تشطيب", "مقاول تشطيبات", "تسليم مفتاح", "فيت اوت",
]

QUERY_ARCHITECT_EN = [
    "engineering consultancy", "architectural design office", "engineering office",
]

QUERY_ARCHITECT_AR = [
    "مكتب هندسي", "استشارات هندسية", "تصميم معماري",
]
