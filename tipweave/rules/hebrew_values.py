"""Fixed values of one community: word lists and lookup tables, in Hebrew.

These are data. They equal the values the rules were written for, so that the same texts give the
same results; names of persons and businesses are left out and can be added through rule tables.
"""

# Fixed values follow.


# words of the topic
FOOD = (
    "מסעד", "בית קפה", "קפה ", " סושי", "סושי ", "פיצה", "פלאפל", "פסטה", "דגים", "חומוס",
    "בראנץ", "ברנץ", "איטלק", "אסיית", "תאילנד", "פרסית", "לבנונ", "מטבח ", "משלוחי ", "משלוחים ",
    "ארוחת בוקר", "ארוחת ערב", "סטייק", "המבורגר", "נודלס", "רמן", "דוכן ", "שוק ", "מאפייה",
    "מאפה ", "יקב ", "בר ",
)

# words that anchor a message in the topic
FOOD_ANCHOR = (
    "מסעדת ", "מסעדה ", "במסעד", "למסעד", "ממסעד", "בית קפה", "עגלת קפה", "קפה ", " בקפה",
    " לקפה", " מקפה", "פיצה", " סושי", "סושי ", "חומוס", "פלאפל", "ארוחת בוקר", "ארוחת ערב",
    "ארוחת צהריים", "בראנץ", "ברנץ", "מאפייה", "מאפה ", "פסטה", "איטלק", "אסיית", "תאילנד",
    "פרסית", "לבנונ", "סטייק", "המבורגר", "נודלס", "רמן", "מטבח ", "משלוחי ", "משלוחים ", "דוכן ",
    "יקב ", "לאכול", "מקום לאכול", "פאב", "נשנוש", "קינוח", "מנות ", "תפריט", "דוכן אוכל",
    "מוצרי מזון", "עסקי מזון", "שוק מחנה", " בשוק ", " בר ",
)

# stems of a strong recommendation
STRONG = (
    "מומלץ", "ממליצ", "חובה לנסות", "חובה ללכת", "חובה לבקר", "דיברו בחום", "ממש אהבנו",
    "מומלצת בחום", "המלצה חמה", "המלצות חמות",
)

# phrases that ask for a recommendation
REQUEST = (
    "אשמח להמלצ", "אשמח על המלצ", "אשמח לשמוע המלצ", "בקשה להמלצ", "בקשת המלצ", "מחפשת המלצ",
    "מחפש המלצ", "מחפשים המלצ", "מחפשות המלצ", "למי יש המלצ", "למישהיא יש המלצ", "למישהי יש המלצ",
    "יש המלצה לבית קפה", "יש המלצה למסעד", "בבקשה המלצה למסעדה", "בבקשה המלצה לבית קפה",
    "בבקשה המלצה לארוחת", "באזורינו?", "באזורנו?", "באזורכם?", "באזורכן?", "באזורם?", "באזורה?",
    "באזורו?", "באיזורנו?", "באיזורכם?", "באיזורכן?", "מה אתן ממליצ", "מה אתם ממליצ",
    "מה את ממליצ", "מישהו יודע מסעד", "מישהו יודע על מסעד", "מישהו יודע לגבי מסעד",
    "מישהו מכיר מסעד", "מישהי מכירה מסעד", "מישהו יכול להמליץ", "יש לכם המלצ", "יש למישהו המלצ",
    "תעזרו לי למצוא", "תעזרו לי עם", "תעזרו לי בבחירת", "מי יודע מסעד", "מי מכיר מסעד",
    "רוצה לשמוע המלצ", "רוצה המלצ", "צריכה המלצ", "צריך המלצ", "צריכים המלצ", "נדרשת המלצ",
    "אפשר המלצ", "תשתפו בהמלצ", "מחפשת מסעד", "מחפש מסעד", "מחפשים מסעד", "מחפשות מסעד",
    "מחפשת בית קפה", "מחפש בית קפה", "מחפשים בית קפה", "מחפשות בית קפה", "מחפשת מקום לאכול",
    "מחפש מקום לאכול", "איפה אוכלים", "איפה אוכלים טוב", "לאן ללכת לאכול", "לאן לאכול",
    "עזרה עם מסעד", "עזרה למצוא מסעד", "תודה על ההמלצ", "תודה לכולן על ההמלצ",
    "תודה לכם על ההמלצ", "תודה מראש בבקשה", "בבקשה תודה מראש", "טובה ורומנטית לשישי בערב בבקשה",
    "בבקשה טובה ורומנטית לשישי בערב", "לשישי בערב בבקשה", "בבקשה לשישי בערב",
    "שאפשר לקחת אליה אור", "שאפשר לקחת אליו אור", "שאפשר לקחת אליה אורח", "שאפשר לקחת אליו אורח",
    "שאפשר לקחת אליה את", "שאפשר לקחת אליו את", "שאפשר לקחת אליה אורחים",
    "שאפשר לקחת אליו אורחים", "אנא המלצתכן", "המלצתכן למסעד", "המלצתכן לבית קפה",
    "המלצה לבית קפה", "המלצות לבית קפה", "המלצה לקפה ", "המלצה לבר", "המלצה לבר/", "המלצות לבר",
    "המלצה למסעדה", "המלצה למסעדת", "המלצות למסעדה", "המלצות למסעדת", "המלצה על מסעדה",
    "המלצות על מסעדה", "מי יכולה להמליץ", "מי יכול להמליץ", "מי יכולות להמליץ", "מנסה שוב:",
    "שאלה מאתגרת", "איזה עגלת קפה", "איזו מסעדת", "איזה מסעדת", "איך קוראים לה", "איך קוראים לו",
    "איך קוראים לבית קפה", "איך קוראים לבית הקפה", "איך קוראים למסעדה", "איך קוראים למסעדת",
    "מישהו יודע במקרה", "מישהי יודעת במקרה", "מישהו יודע איך קוראים", "מישהי יודעת איך קוראים",
    "שמעה על מסעד", "שמעתי על מסעד", "שמעת על מסעד", "שמעו על מסעד", "מישהו שמע על",
    "מישהי שמעה על", "נשמע על מסעד", "איפה בית הקפה", "איפה יש בית קפה", "איפה יש מסעד",
    "איפה המסעדה", "איפה זה קפה", "איפה זה בית קפה", "איפה זה בית הקפה", "איפה זה המסעדה",
    "הייתי שמחה לקבל", "הייתי שמח לקבל", "נשמח לקבל כל מידע",
)

# phrases of other topics
EXCLUDE = (
    "המלצות על מלון", "מלון ומסעדות ברומא", "מורה פרטי", "מורה למתמטיקה", "אינסטלטור", "חשמלאי",
    "רופא ", "וטרינר", "פסיכולוג", "טכנאי", "מעצב", "צלם ", "נגר ", "שיפוצניק", "עורך דין",
    "מאמן כושר", "מחפשת המלצות ל", "מחפש המלצות ל", "ביקשו להפיץ", "vcf", ".vcf",
    "הכי משמעותי ומעורר שקראתי", "עיסוי תינוקות", "מעגל אימהות", "חסימת הצמתים", "חסימות הצמתים",
    "צעדה להסתדרות", "מחאת ההייטקיסטים", "מחאת הגלימות", "שיירת הצפון", "יציאה לשיירה",
    "דיסק הקשיח", "תפרמט לכם את הטלפון", "אגף טכנולוגיות מידע", "טכנולוגיות מידע – משרד",
    "שיחות לא מזוהות בשום מקרה", "דילמה עסקית", "דילמות עסקיות", "למי יש דילמה",
    "לפתרון דילמות עסקיות", "יעסוק בפתרון דילמות", "ועד האגודה והנהלת", "ועד האגודה משיקוליו",
    "דרישה להסדיר מספר עניינים במושב", "מועדון אזורי לניצולי שואה",
    "מועדון אזורי לניצולי שואה במועצה שלנו", "מועדון לניצולי שואה", "לניצולי שואה במועצה",
    "ניצולי שואה במועצה", 'קפה בשדה"- מועדון אזורי', "קפה בשדה- מועדון לניצולי שואה",
    "כרגע בתקיפה ארצית של המנהל", "תקיפה ארצית של המנהל", "לבר ומהבר שוב למסעדה", "ל24 שעות",
    "ל 24 שעות", "נטוורקינג למרצים", "תכנית ההרצאות", "מעבירה אליכם פלייר", "מתמחה בקינוחים",
)

# coffee products
EXCLUDE_PRODUCT = (
    "מכונת קפה", "מכונות קפה", "קפסולות קפה", "קפסולות למכונת", "קפסולות", "קפסולת", "שקיות קפה",
    "שקית קפה", "חבילות קפה", "חבילת קפה", "אבקת קפה", "אבקת נמס", "קפה נמס", "קפה בקפסולות",
    "קפה טחון", "פולי קפה", "טחינת קפה", "סוגי קפה", " סוג קפה", "סוג קפה ", "פודים", "פוד ",
    "מילוי קפסול", "תואם למכונת", "טורקי סגורות", "טורקי סגורות חדשות", "סגורות חדשות בתוקף",
)

# months
MONTHS = (
    "ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר",
    "נובמבר", "דצמבר",
)

# words after the word for cafe that begin no name
CAFE_FIRST_WORDS = (
    "בדשא", "בבית", "במשרד", "ברכב", "במכונית", "בכוס", "עם", "של", "בלי", "שחור", "חם", "קר",
    "בתקופות", "בזמן", "במשך", "בימים", "בחודשים", "בשנת", "בעת", "מהמכונה",
)

# words after 'in a cafe' that begin no name
CAFE_TAIL_WORDS = (
    "בתקופות", "בזמן", "במשך", "בימים", "בחודשים", "בשנת", "בעת",
)

# beginnings of captures that are places, not names
CAFE_PREFIXES = (
    "ביד", "בפה", "בבית", "בגינה", "בחצר", "בהוד", "בכיכר", "במרפסת", "בדרך", "במכונית", "ברכב",
    "באוטו",
)

# beginnings of captures that are times
VENUE_PREFIXES = (
    "בימי", "ביום", "בשבת", "בחג", "בלילה", "בערב",
)

# first words that are no name before a dash
LEAD_WORDS = (
    "ב", "ל", "מ", "של", "על", "עם", "את", "גם", "יש", "כל", "לא", "כי", "אבל", "או", "זה", "זו",
    "מה", "איך", "למה",
)

# words after 'also' that begin no name
ALSO_WORDS = (
    "אני", "אתה", "אתם", "אתן", "אנחנו", "הם", "הן", "זה", "זו", "מה", "שם", "כל", "כמה", "כולם",
    "כן", "לא", "פה", "יש", "אין", "הסגר", "העברה", "הערב", "הפתעה", "הצלחה", "הקדם", "הרצאה",
    "התאם", "התנדבות", "בתוך", "בלי",
)

# texts that are no name
BAD_NAMES = (
    "מישהי", "מישהו", "שם", "אתמול", "היום", "מחר", "שם המסעדה", "פה", "אכזריות",
)

# describing first words
DESCRIPTOR_LEADS = (
    "טובה", "מעולה", "נהדרת", "נחמד", "נחמדה", "נעים", "מומלצת", "מומלץ", "מומלצים", "שווה",
    "מדהימה", "מצוינת", "איטלקית", "אסייתית", "אסיאתית", "תאילנדית", "דגים", "בשרים", "סושי",
    "פתוחה", "פתוח", "חדשה", "חדש",
)

# category first words
CATEGORY_WORDS = (
    "דגים", "בשרים", "סושי", "פיצה", "פסטות", "מסעדה", "מסעדת", "ברגר", "בורגרים", "מאפה", "קפה",
    "טעימה", "טעים", "נחמד", "נחמדה", "חמוד", "חמודה", "כייפית", "יפנית", "היא", "המבוגרים",
    "סופר", "ישראלית", "עממית", "מזרחית", "הודית", "יוונית", "טבעונית", "חדשה", "חדש", "החדש",
    "הכי", "המומלצת", "המתנה", "הנחמד", "הפתוחים", "המדרחוב", "המבורגרים",
)

# second words after a category
CATEGORY_FOLLOWERS = (
    "טובה", "מעולה", "נהדרת", "נחמדה", "נחמד", "מומלצת", "מומלץ", "באזור", "באיזור", "בשרון",
    "בנמל", "ביפו", "בתל", "בירושלים", "באילת", "עם", "שעושה", "שעושים", "ממש",
)

# places and general words that are no name by themselves
GENERIC_EXACT = (
    "רעננה", "כפר סבא", "כפר-סבא", "כפ״ס", 'כפ"ס', "תל אביב", 'ת"א', "ת״א", "יפו", "יפו העתיקה",
    "נתניה", "הרצליה", "חיפה", "ירושלים", "יהוד", "הוד השרון", 'הוד"ש', "אילת", "רמת גן",
    "גבעתיים", "פתח תקווה", "קרית אונו", "קריית אונו", "רמת החייל", "רמת השרון", "זכרון יעקב",
    "ראש פינה", "טבריה", "באר שבע", "עכו", "נהריה", "בת ים", "חולון", "אזור", "אזורינו", "אזורנו",
    "אזורכם", "אזורכן", "אזורם", "אזורה", "אזורו", "איזורנו", "איזורכם", "איזורכן", "איזור",
    "ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר",
    "נובמבר", "דצמבר", "סביבה", "השרון", "שרון", "טירה", "המרכז", "הצפון", "הדרום", "הגליל",
    "גליל", "גליל המערבי", "עוטף", "צופית", "בצרה", "פלורנטין", "נווה צדק", "שוק מחנה יהודה",
    "שדרות", "שדה", "מושב", "קיבוץ", "קיצור", "תודה", "בוקר", "ערב", "שבת", "חג", "עזרה", "קבוצה",
    "משפחה", "ילדים", "אינטרנט", "וואטסאפ", "שלום", "בית", "בית קפה", "מסעדה", "מסעדות", "שוק",
    "ים", "חוף", "נמל", "מקום", "משהו", "אוכל", "בשרים", "דגים", "סושי", "פיצה", "חומוס", "בר",
    "פאב", "מאפה", "מאפייה", "שף", "מטבח", "עולם", "אירופה", "איטליה", "לונדון", "פריז",
    "אמסטרדם", "אתונה", "ורשה", "רומא", "תאילנד", "סין", "ספרד", "ארה״ב", 'ארה"ב', "ישראל",
)

# fragments that are no name
JUNK_EXACT = (
    "גדול", "גדים", "חום", "חוםםםםםם", "חד פעמית", "חופש", "חזית", "חיינו", "חינם", "חירתכם",
    "חלל", "חשבון", "טבע", "טוח", "טלוויזיה", "יום יומית", "יומן", "יומו", "יטוחים", "יטחוני",
    "ימיינו", "ינוני", "יניהם", "יקורת", "יתי", "כבר ראיתי", "כולנו", "כושר", "כי", "כלל", "לבד",
    "ליבם", "חרוצים", "טובה ורומנטית לשישי בערב", "טורקי סגורות חדשות בתוקף עד יולי",
    "מעל שבועיים",
)

# rests of words after a cut-off preposition
CAPTURE_FRAGMENTS = (
    "איטליזים", "אתר", "ביט", "ביד", "הסגר", "העברה", "הערב", "הפתעה", "הצלחה", "הקדם", "הרצאה",
    "התאם", "התנדבות", "ואו", "וגר", "וגרות", "ודד", "ודדים", "וכה", "וטיק", "וינגייט", "ויתקין",
    "וולט", "וואטפס", "ובה", "ואכם", "וקר", "ורוכוב", "גין", "מטבח",
)

# single words that are no name
SOLO_WORDS = (
    "נעים", "נעימה", "נעימים", "כשרה", "כשרות", "טובה", "טוב", "מעולה", "נהדר", "נהדרת", "נחמד",
    "נחמדה", "שווה", "מומלץ", "מומלצת", "מומלצים", "מדהים", "מדהימה", "מצוין", "מצוינת", "אהבה",
    "תודה", "אמת", "אור", "ארץ", "ארי", "ים", "חוף", "שף", "בר", "בירה", "בקשה", "בקשישים",
    "ברזילאית", "מכולת", "פאב", "אכזריות", "אמצע", "אם", "את", "עבודה", "אירועים", "עיסוק",
    "תצוגה", "ית", "אותנו", "אודים", "גרון", "בחינם", "בחג", "איטליזים", "אתר", "בהודש", "ביד",
    "ביט", "הסגר", "העברה", "הערב", "הפתעה", "הצלחה", "הקדם", "הרצאה", "התאם", "התנדבות", "ואו",
    "וגר", "וגרות", "ודד", "ודדים", "וכה", "וטיק", "וינגייט", "ויתקין", "וולט", "וואטפס", "ובה",
    "ואכם", "וקר", "ורוכוב", "טוח", "יומן", "דיוק", "דקא", "דרכו", "דרשי", "הזו", "זן", "לילה",
    "נו", "נט", "נות", "פרו", "צל", "רל", "רים", "ריאה", "ריאות", "רורות", "רמות", "רצינית",
    "סוף", "סלטה", "סמוך", "חצר", "טירוף", "יותר", "יחד", "תים", "תיק", "ננה", "נעי", "נוסף",
    "לב", "ליד", "מספר", "מועצה", "מדינה", "מפגשים", "מיוחד", "מפנקים", "עלינו", "פנים", "פעיל",
    "פרטי", "שבוע", "שבועות", "שישי", "שכונה", "שלי", "שמחה", "שנה", "שבתות", "שבתחנה", "רחובות",
)

# markers of watch repair
WATCH_MARKERS = (
    "תיקון שעונים", "חנות שעונים", "שעונאי", "שעונים", "שען",
)

# markers of photography
PHOTO_MARKERS = (
    "צילום", "צלם", "צלמת", "צילומי", "צילומים", "מצלם", "מצלמת", "צילומי משפחה",
)

# markers of swimming
SWIM_MARKERS = (
    "שחייה", "שחיה", "בריכה", "בריכת", "שחיין", "שחיינית", "מורה שחייה",
)

# markers of a garage
GARAGE_MARKERS = (
    "מוסך", "צמיג", "צמיגים", "טכנאי רכב", "חשמלאי רכב", "פחח", "פחחות",
)

# medicine: (word, sub-label), first match wins
MEDICINE = (
    ("כירורג שד", "כירורג שד"),
    ("כירורגית שד", "כירורג שד"),
    ("כירורגית", "כירורגיה"),
    ("כירורג", "כירורגיה"),
    ("כרורגית", "כירורגיה"),
    ("כרורג", "כירורגיה"),
    ("גסטרו ילדים", "גסטרו ילדים"),
    ("גסטרולוגית", "גסטרו"),
    ("גסטרולוג", "גסטרו"),
    ("גסטרו", "גסטרו"),
    ("אף אוזן גרון", "א.א.ג"),
    ("א.א.ג", "א.א.ג"),
    ("אף אוזן", "א.א.ג"),
    ("אנדוקרינולוגית", "אנדוקרינולוגיה"),
    ("אנדוקרינולוג", "אנדוקרינולוגיה"),
    ("קרדיולוגית", "קרדיולוגיה"),
    ("קרדיולוג", "קרדיולוגיה"),
    ("אורולוגית", "אורולוגיה"),
    ("אורולוג", "אורולוגיה"),
    ("נוירולוג", "נוירולוגיה"),
    ("נוירוכירורג", "נוירוכירורגיה"),
    ("ראומטולוג", "ראומטולוגיה"),
    ("ראמוטולג", "ראומטולוגיה"),
    ("אורתופד", "אורתופדיה"),
    ("אורטופד", "אורתופדיה"),
    ("עמוד שדרה", "עמוד שדרה"),
    ("פסיכוגראטר", "פסיכוגריאטריה"),
    ("פסיכוגריאטר", "פסיכוגריאטריה"),
    ("פסיכיאטר", "פסיכיאטריה"),
    ("פסיכיאטרית", "פסיכיאטריה"),
    ("פסיכיאטרי", "פסיכיאטריה"),
    ("פסיכיאטריה", "פסיכיאטריה"),
    ("פסיכולוג", "פסיכולוגיה"),
    ("פסיכולוגית", "פסיכולוגיה"),
    ("פסיכולוגי", "פסיכולוגיה"),
    ("עור ילדים", "עור ילדים"),
    ("רופא עור", "עור"),
    ("רופאת עור", "עור"),
    ("עיניים", "עיניים"),
    ("רופא עיניים", "עיניים"),
    ("רופאת עיניים", "עיניים"),
    ("קטרקט", "עיניים"),
    ("נשים", "נשים"),
    ("רופא נשים", "נשים"),
    ("רופאת נשים", "נשים"),
    ("גינקולוגית", "גינקולוגיה"),
    ("גינקולוג", "גינקולוגיה"),
    ("ילדים", "ילדים"),
    ("ילד", "ילדים"),
    ("פדיאטר", "ילדים"),
    ("פדיאטריה", "ילדים"),
    ("משפחה", "רפואת משפחה"),
    ("משפחתי", "רפואת משפחה"),
    ("גרנטולוג", "גריאטריה"),
    ("גרונטולוג", "גריאטריה"),
    ("גריאטר", "גריאטריה"),
    ("אלרגיה", "אלרגיה"),
    ("אלרגולוג", "אלרגיה"),
    ("אונקולוג", "אונקולוגיה"),
    ("אונקולוגית", "אונקולוגיה"),
    ("פלסטיקאית", "כירורגיה פלסטית"),
    ("פלסטיקאי", "כירורגיה פלסטית"),
    ("אף", "אף"),
    ("שיניים", "שיניים"),
    ("ריאות", "ריאות"),
    ("רופא ריאות", "ריאות"),
    ("גסטר", "גסטרו"),
)

# dentistry: (word, sub-label), first match wins
DENTAL = (
    ("אורתודנט", "אורתודנטיה"),
    ("אורטודנט", "אורתודנטיה"),
    ("אנדו", "אנדודונטיה"),
    ("אנדודונט", "אנדודונטיה"),
    ("שיננית", "שיננית"),
    ("שיננאי", "שיננאי"),
    ("כירורג", "כירורגיה"),
    ("כירורגית", "כירורגיה"),
    ("פה ולסת", "פה ולסת"),
    ("שתלים", "שתלים"),
    ("יישור", "יישור שיניים"),
    ("ילדים", "ילדים"),
)

# complementary medicine: (word, sub-label), first match wins
COMPLEMENTARY = (
    ("דיקור סיני", "דיקור סיני"),
    ("דיקור יבש", "דיקור יבש"),
    ("דיקור", "דיקור"),
    ("כירופרקטית", "כירופרקטיקה"),
    ("כירופרקט", "כירופרקטיקה"),
    ("כירופרכט", "כירופרקטיקה"),
    ("רפלקסולוג", "רפלקסולוגיה"),
    ("שיאצו", "שיאצו"),
    ("נטורופת", "נטורופתיה"),
    ("יוגה", "יוגה"),
)

# paramedical: (word, sub-label), first match wins
PARA = (
    ("פיזיותרפיסטית", "פיזיותרפיה"),
    ("פיזיותרפיסט", "פיזיותרפיה"),
    ("פיזיותרפיה", "פיזיותרפיה"),
    ("קלינאית תקשורת", "קלינאות תקשורת"),
    ("קלינאי תקשורת", "קלינאות תקשורת"),
    ("קלינאות תקשורת", "קלינאות תקשורת"),
    ("ריפוי בעיסוק", "ריפוי בעיסוק"),
    ("מרפא בעיסוק", "ריפוי בעיסוק"),
    ("דיאטנית", "תזונה"),
    ("דיאטן", "תזונה"),
    ("תזונאי", "תזונה"),
    ("רוקחת", "רוקחות"),
    ("רוקח", "רוקחות"),
    ("רוקחות", "רוקחות"),
)

# private teaching: (word, sub-label), first match wins
TEACHING = (
    ("הוראה מתקנת", "הוראה מתקנת"),
    ("מתמטיקה", "מתמטיקה"),
    ("לשון", "לשון"),
    ("אנגלית", "אנגלית"),
    ("עברית", "עברית"),
    ("פיזיקה", "פיזיקה"),
    ("כימיה", "כימיה"),
    ("ביולוגיה", "ביולוגיה"),
    ("מורה לחשבון", "חשבון"),
    ("מורת חשבון", "חשבון"),
    ("חשבון", "חשבון"),
    ("קראטה", "קראטה"),
    ("בר מצווה", "בר מצווה"),
)

# music: (word, sub-label), first match wins
MUSIC = (
    ("פסנתר", "פסנתר"),
    ("גיטרה", "גיטרה"),
    ("תופים", "תופים"),
    ("חליל", "חליל"),
    ("כינור", "כינור"),
    ("צ'לו", "צ'לו"),
    ("נגינה", "נגינה"),
)

# mining: (pattern, category), first match wins
MINING_PATTERNS = (
    (r"מורה\s+ל(?:שון|לשון)", "מורים פרטיים"),
    (r"לשון", "מורים פרטיים"),
    (r"מורה\s+ל(?:אנגלית|עברית)", "מורים פרטיים"),
    (r"פסיכולוג", "פסיכולוגיה"),
    (r"מאבחן\s+דידקטי", "מורים פרטיים"),
    (r"הוראה מתקנת", "מורים פרטיים"),
    (r"רופא שיניים|רופאת שיניים|שיננית|אורטודנט", "רפואת שיניים"),
    (r"חשמלאי|חשמל", "חשמל"),
    (r"אינסטלטור|אינסטלציה", "אינסטלציה"),
    (r"נגר|נגרות", "נגרות"),
    (r"צבע|צבעי|צביעה", "צבע"),
    (r"מזגן|מיזוג|מזגנים", "מיזוג"),
    (r"מונית|נהג מונית", "מוניות"),
    (r"מספרה|ספר לשיער", "מספרה"),
    (r"מנעולן", "מנעולן"),
    (r"הדברה|מדביר", "הדברה"),
    (r"ניקיון|נקיון|מנקה|עוזרת בית", "ניקיון"),
    (r"תפירה|תופרת", "תפירה"),
    (r"קייטרינג", "קייטרינג"),
    (r"אילוף כלבים|מאלף כלבים", "אילוף כלבים"),
    (r"מחשבים|טכנאי מחשבים", "טכנאי מחשבים"),
    (r"טכנאי מכשירי חשמל|מדיח|תנורים|מכונת כביסה", "טכנאי מכשירי חשמל"),
    (r"תריסים", "תריסים"),
    (r"אלומיניום", "אלומיניום"),
    (r"אזעקה", "אזעקה"),
    (r"הובלה|מוביל", "הובלות"),
    (r"עיסוי|מסאג|מעסה|רפלקסולוג", "עיסוי"),
    (r"וטרינר", "רפואה"),
    (r"רופא|רופאה|מרפאה", "רפואה"),
    (r"בר מצווה|ברית", "מורים פרטיים"),
    (r"גננת|סייעת גן", "גני ילדים"),
    (r"פיזיותרפיסט|פיזיותרפיה", "רפואה"),
    (r"קוסמטיקאית|מניקור|פדיקור|לק גל", "קוסמטיקה"),
    (r"מדריך טיולים|מדריכת טיולים", "תיירות"),
    (r"שחיה|שחייה|בריכה", "שחייה"),
    (r"ספרית|ספרות", "מספרה"),
    (r"ביטוח", "ביטוח"),
    (r"עורך דין|עורכת דין", "משפטים"),
    (r"רואה חשבון|רואת חשבון", "ראיית חשבון"),
    (r"גז", "גז"),
    (r"זגג|זגגות", "זגגות"),
    (r"איטום", "איטום"),
    (r"פרגולה|פרגולות", "נגרות"),
    (r"דודים|דוד שמש", "דודים"),
    (r"עובש|טיפול בעובש", "איטום"),
)

# category rules in declared order: (target, scope, include, exclude)
CATEGORY_RULES = (
    ("דיקור", ("name", "field",),
     ("דיקור", "מדקר", "מדקרת",),
     ("אנדוקרינולוג", "פדיקור",)),
    ("אלומיניום", ("name", "field",),
     ("אלומיניום", "אלומינ",),
     ()),
    ("אדריכלות", ("name", "field",),
     ("אדריכל", "אדריכלות",),
     ()),
    ("אטליז", ("name", "field",),
     ("אטליז", "איטליז", "קצב",),
     ()),
    ("אזעקה", ("field",),
     ("אזעקה", "אזעקות",),
     ()),
    ("מספרה", ("name", "field",),
     ("מספרה", "מספרי", "ספרית", "תספורת", "החלקת שיער", "צבע לשיער", "הספר", " ספר ",),
     ("לספרות", "מורה לספרות",)),
    ("ביטוח", ("name", "field",),
     ("ביטוח", "ביטוחים", "סוכן ביטוח", "סוכנות ביטוח", "סןכן ביטוח",),
     ()),
    ("דודים", ("name", "field",),
     ("דוד שמש", "דודי שמש", "דוד חשמל", "דודי חשמל", "דודי שמש וחשמל", "דוד מים", "דודי מים", "דוד מיים", "דודי מיים", "מתקין דוד", "מתקין דודים", "טכנאי דוד", "טכנאי דודים", "תיקון דוד", "דודים",),
     ()),
    ("נגרות", ("name", "field",),
     ("נגרות", "נגריה", "הנגר",),
     ()),
    ("קייטרינג", ("name", "field",),
     ("קייטרינג", "הסעדה",),
     ()),
    ("סלולר", ("name", "field",),
     ("סלולר", "טלפון נייד", "טלפונים סלולר", "טכנאי טלפון", "טכנאי פלאפון", "טכנאי טלפונים סלולר", "פלאפון", "תיקון טלפון", "תיקון פלאפון", "מסך פלאפון",),
     ()),
    ("טכנאי מחשבים", ("field",),
     ("טכנאי מחשבים", "מחשבים",),
     ()),
    ("קוסמטיקה", ("name", "field",),
     ("קוסמטיקה", "קוסמטי", "איפור", "מעסה", "עיסוי", "מכון יופי", "טיפוח", "יופי",),
     ()),
    ("רפואת שיניים", ("name", "field",),
     ("רפואת שיניים", "רופא שיניים", "רופאת שיניים", "מרפאת שיניים", "שיננית", "שינני", "שיניים", "אורתודונט", "מומחיות לשיניים",),
     ()),
    ("חשמל", ("name", "field",),
     ("חשמלאי", "חשמל",),
     ("רכב", "חשמלאי רכב", "חשמלאות רכב", "מערכות חשמל לרכב", "טכנאי מכשירי חשמל", "מכשירי חשמל", "אופנים חשמליים", "מחסני חשמל", "דודי שמש וחשמל",)),
    ("רפואה", ("name", "field", "note",),
     ("רופא עיניים", "רופאת עיניים",),
     ()),
    ("גז", ("name", "field",),
     ("טכנאי גז", "חברת גז",),
     ()),
    ("הדברה", ("field",),
     ("מדביר", "הדברה", "הדברת", "נמלים", "ריסוס", "יתושים", "מזיקים", "חרקים",),
     ()),
    ("הובלה", ("field",),
     ("הובלה", "הובלות", "הובלת", "מוביל", "מובילים",),
     ()),
    ("אינסטלציה", ("field",),
     ("אינסטלציה", "אינסטלטור", "צנרת", "שרברב",),
     ()),
    ("מכבסה", ("name", "field",),
     ("כביסה", "כביסות", "מכבסה", "מכבס", "מכונת כביסה", "מכונות כביסה",),
     ()),
    ("עריכת דין", ("name", "field",),
     ("עריכת דין", "עורך דין", "עורכת דין", 'עו"ד', "עו״ד", "נוטריון",),
     ()),
    ("מנעולן", ("name", "field",),
     ("מנעולן", "מנעולים", "מנעול", "פורץ", "פורצים", "פורץ דלתות", "שכפול מפתחות", "מפתחות",),
     ()),
    ("איפור", ("name", "field",),
     ("איפור", "מאפר", "מאפרת",),
     ()),
    ("רפואה", ("name", "field",),
     ("רופא", "רופאה", "רפואה", 'ד"ר', "דוקטור", " דר ", "רופא עיניים", "רופאת עור", "רופא עור", "רופא נשים", "רופא אף אוזן", "מרפאה", "מרפא", "רפואי", "רפואית", "אורתופד", "אורטופד", "אורתופדיה", "אנדוקרינולוג", "אנדוקרינולוגית", "כירורג", "כירורגיה", "פסיכיאטר", "פסיכיאטרית", "פסיכוגריאטר",),
     ("שיניים", "רופא שיניים", "רופאת שיניים", "מרפאת שיניים", "שיננית", "שינני", "אורתודנט", "אורתודונט", "אורתודנטיה",)),
    ("מספרה", ("field",),
     ("מספרה", "ספרית", " ספר ",),
     ()),
    ("מיזוג", ("field",),
     ("מיזוג", "מזגן", "מזגנים",),
     ()),
    ("נהיגה", ("field",),
     ("נהיגה", "מורה נהיגה", "מורה לנהיגה",),
     ()),
    ("ניקיון", ("field",),
     ("נקיון", "ניקיון", "מנקה", "מנקים", "ניקוי",),
     ()),
    ("ריפוי בעיסוק", ("name", "field",),
     ("ריפוי בעיסוק", "מרפא בעיסוק", "מרפאה בעיסוק",),
     ()),
    ("אופטיקה", ("name", "field", "note",),
     ("אופטיקה", "אופטיקאי", "אופטיקאית", "אופטימטריסט", "אופטומטריסט", "אופטומטריסטית", "משקפיים", "חנות משקפיים", "בדיקת ראייה", "עדשות מגע", "מולטיפוקל",),
     ()),
    ("אורתודנטיה", ("name", "field",),
     ("אורתודנט", "אורתודונט", "אורתודנטיה",),
     ()),
    ("צבע", ("name", "field",),
     ("צבעי", "צביעה", "צבעות", "מצבעה", "הצבע", "טיח צבע",),
     ("צבע לשיער",)),
    ("רפואה", ("field",),
     ("רפואה", "רופא", "רופאה", "רופאת", "מרפאה", "דר'", "דר ",),
     ()),
    ("תפירה", ("name", "field",),
     ("תפירה", "תפירת", "תופר", "תופרת", "מכונת תפירה",),
     ()),
    ("מוניות", ("name", "field",),
     ("מונית", "מוניות", "נהג מונית", "נהגת מונית", "טקסי",),
     ()),
    ("מורים פרטיים", ("field",),
     ("מורה", "מורים", "הוראה",),
     ("נהיגה",)),
    ("טכנאי מכשירי חשמל", ("field",),
     ("טכנאי מכשירי חשמל", "מכשירי חשמל", "טכנאי מדיח", "טכנאי מדיחים", "מכונת כביסה", "מכונות כביסה", "טכנאי תנור", "טכנאי תנורים", "טכנאי מייבש", "טכנאי מקרר", "טכנאי מקררים", "תיקון כיריים", "כיריים ותנור",),
     ()),
    ("נסיעות", ("name", "field",),
     ("סוכן נסיעות", "סוכנת נסיעות", "סוכן/ת נסיעות", "נסיעות",),
     ()),
    ("תריסים", ("field",),
     ("תריסים", "תריס",),
     ()),
    ("ריפוד", ("name", "field",),
     ("ריפוד", "ריפודים", "רפד", "מרפד", "מרפדייה", "מרפדיית",),
     ()),
    ("חשמל רכב", ("name", "field",),
     ("חשמל רכב", "חשמלאי רכב", "חשמלאות רכב", "מערכות חשמל לרכב", "חשמל לרכב",),
     ()),
    ("איטום", ("name", "field",),
     ("איטום", "מאטם", "אוטם",),
     ()),
    ("זגגות", ("field",),
     ("זגגות", "זגג", "זכוכית", "לזגג",),
     ()),
)

# Phrases that are part of no venue name.
REJECT_PHRASES = (
    "דגים ופירות ים", "דגים ופרות ים", "הישנה שלכם", "הישן שלכם", "הנחמד הקרוב", "דיסק הקשיח",
    "דילמה", "בתקופות", "מועדון אזורי לניצולי שואה", "בתעסוקה ומגורים", "חלוש ידבר איתך",
    "כרגע בתקיפה ארצית של המנהל", "תקיפה ארצית של המנהל", "לבר ומהבר שוב למסעדה", "ל24 שעות",
    "ל 24 שעות", "כבר ראיתי", "יטוחים", "יטחוני", "ימיינו", "ינוני", "יניהם", "יקורת", "כולנו",
    "כושר", "ליבם", "מכונת קפה", "מכונות קפה", "קפסולות קפה", "קפה בקפסולות", "שקיות קפה",
    "שקית קפה", "חבילות קפה", "חבילת קפה", "אבקת קפה", "אבקת נמס", "קפה נמס", "פולי קפה",
    "סוגי קפה", "נספרסו", "פודים", "טורקי סגורות", "סגורות חדשות בתוקף", "בחגור גם",
    "אחלה מוצרים", "מוצרים אחרים", "בגינה - לרוב", "ברוב האנשים אין גינה", "בחצר המשחקים",
    "באוירה פסטורלית", "בבית יהושע בימי", "ביום שלישי אחהצ", "בימי סגורה", "באתר הזה",
    "איטליה בסמוך", "בין השרון", "בין תל אביב", "בין הים", "בין רעננה", "עסק שעושה",
    "שעושה משלוח", "שעושים משלוח", "שעושה שליח", "דרושים מלצר", "דרושים עובד", "דרושים ברמן",
    "מחפשת מישהו", "מחפש מישהו", "האם באמת", "על האירנים", "על הדמוקרטיה", "על הדשא",
    "על כל אנשי", "על כל גרם", "על עלובי", "עם דיוקים", "עם מאפים ועוגיות", "עם עוגות מעולות",
    "עם חדר פרטי", "עם שליחויות", "של המוזיאון", "של המכולת", "של הבן שלי", "של מילואמניק",
    "של חומוס שגם", "של ישראלי אבל", "של גיסי", "של שגב", "vcf", ".vcf", "http://", "https://",
    "whatsapp", "לכל שימוש אחר", " חדר פרטי ", " חדר נפרד ", " לארוחת ", " למשפחה ", " עם ילדים ",
    " שאפשר למצוא ", " שאפשר להזמין ", "שאפשר לקחת אליה אור", "שאפשר לקחת אליו אור",
    "שאפשר לקחת אליה אורח", "שאפשר לקחת אליו אורח", " שאפשר לקחת אליה ", " שאפשר לקחת אליו ",
    "המלצתכן למסעד", "אנא המלצתכן", " שפתוחה בשישי ", " שפתוח בשבת ", " קרובה למשפחה ",
    " קרוב לרכבת ", " קרוב עם אפשרות ", " משהו חצי הדרך ", " עד תל אביב ", " בסביבה (",
    " באזורנו ", "באזורינו", "באזורנו", "באזורכם", "באזורכן", "באזורם", "באזורה", "באזורו",
    "באיזורנו", "באיזורכם", "באיזורכן", "באיזורם", "באיזורה", "באיזורו", "איטלקית קטנה וחמודה",
    "איטלקית ממש משפחתית נחמדה וטעימה", "אינטימית ומאד טובה באזור", "אירנית כנראה",
    "כנראה של הודעות", "הפרות כביכול", "אם הילדים שלנו", "אם משאירים", "אם זה", "אצלך סבירה",
    "אצל השכנה", "את הכלבים שלי", "את הקפוצ'ינו", "את רותי", "מסתובבת חופשי", "מסתובב חופשי",
    " בשיכון ", " באיזורנו ", "מיוחדת היא מסעדת", "וארגוני המחאה", " אחים לנשק",
    "מטבח מבשל באולם", "אולם אירועים אביגדור",
)

# Phrases of talk, time and other topics that are no venue.
CHAT_PHRASES = (
    "מעל שבועיים", "מעל שבוע", "מאות עסקים של", "מפגשים 7", "מעולה (כבר אמרנו", "מעולה ומומלצת",
    "מעולה צריך להזמין", "מצוינת וגדולה", "מצוות", "מקביל", "מרחב", "מהמכונה", "מתקרר", "מדעי ☕",
    "מוסיקה", "מחלקות", "נושא", "נחת", "ניקיון", "נקראת", "נסגר", "נתניה מגיע הביתה", "סבלנות",
    "סדרה", "סוכות", "סיפוק", "עבורנו", "עצמאות", "עצמם", "עצמנו", "פוסט", "פקק", "פתוחה הבוקר",
    "פתוחה עכשיו", "פתוחים ביום ששי", "קצת כסף", "תחום", "תחפושת", "תשלום", "תמיכתו",
    "תעמוד לרשות", "יוצא גם הוא לחופש", "כתובת", "רומז לנו", "שיתוק", "שלטון", "שפע",
    "שצריכה להגיע", "שקרוב לפארק", "תופרת ושם", "למי שכבר מורגל", "למעט לקוחות", "למפקד הקרוב",
    "לשעבר", "מי שרוצה מוזמנת", "מילואימניקים", "מי שכבר", "שלא שומרים", "ששנראית מתוקה",
    "שליד הגן", "נמצאת ב w hotel", "טובה ליד", "ליפשיץ הנהדר", "ליפשיץ כמובן", "ליפשיץ פתוח",
    "ליפשיץ פתוח מחר", "ליפשיץ🙏", "ליפשיץ במכולת", "ליפשיץ במקולת", "מה זה טעים", "מגניב ☕",
    "מגניב לארוחות", "מונטיפיורי ועוד", "מוצ''ש", "מצד ימין בשר", "מקסיקנית של המאכל", "מתיתיהו",
    "נאדי 4", "נעי ם", "סגורה והחל", "עוטף - נתיב", "עושה משלוחים של אוכל", "פלאזה ליד גן",
    "פופולר תל אביב", "פיאנו פיאנו", "פייבוקס", "פסטה לוקו", "צבעים בקפה", "צרפתי מאלף",
    "קוקו בתוך hotel", "קטן ו2 כורסאות", "קלילה אז יש", "קפה עושה שלום", "קפה שושה", "ראסרי",
    "רדיוס", "רומנטית משהו", "רמב״ן גם טובה", "שבחוות הסוסים", "שבט", "שבילך", "שבילכם",
    "שושה בצופית", "שיאה", "שייקים גלידה", "ששולחים דרך wolt", "תאילנדית חדשה בנתניה", "תל יצחק",
    "תמונות", "בתא בצמרות", "בשם burger station", "בורגרז בטירה", "בטירה בשם", "הכי שוות ברדיוס",
    "המדרחוב בכפר", "המדרחוב משעה", "המוכר מאפים", "החדש במושב", "החדש בצופית", "היוונית במתחם",
    "מדליקה בסביבה",
)
