"""Lists, patterns and limits that results depend on."""

from html.entities import name2codepoint

#: Named references: those of HTML 4, and apos; a no-break space reads as a blank.
REFERENCES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
#: References that need no semicolon.
BARE_REFERENCES = ["amp", "lt", "gt", "quot", "nbsp"]
#: What the numeric references 128 to 159 mean: Windows-1252, where it has a character.
CP1252 = {code: bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(128, 160)}
SCAN_CHARS = 20_000
HTML_SCAN_CHARS = 200_000
MAX_MESSAGE_BYTES = 15 * 1024 * 1024
TOKEN_CAP = 5_000
HEADER_NAMES_CAP = 64
HOP_CAP = 100
LONG_CHAIN = 15
URGENCY = [
    "urgent", "immediately", "action required", "account suspended", "account has been limited", "verify your account", "wire transfer", "wire funds", "gift card", "confidential",
    "kindly", "asap", "act now", "final notice", "password expires", "password will expire", "limited time", "failure to comply", "legal action", "response is required",
]
#: Addresses that begin with bc1 have 42 or 62 characters, without 1, b, i and o after that; hex digests are none.
FINANCIAL = {
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    "swift_bic": r"(?i)\b(?:swift|bic)\b[^\n]{0,20}?\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b",
    "routing_number": r"(?i)\brouting\b[^\n]{0,20}?\b\d{9}\b",
    "crypto_wallet_btc": r"\b(?:bc1[02-9ac-hj-np-z]{39}(?:[02-9ac-hj-np-z]{20})?|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b",
    "crypto_wallet_eth": r"\b0x[a-fA-F0-9]{40}\b",
    "gift_card_request": r"(?i)\b(?:amazon|itunes|apple|google\s*play|steam|visa|target|walmart)\s+gift\s*cards?\b",
}
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "gov.uk", "ac.uk", "co.in", "net.in", "org.in", "co.jp", "co.nz", "co.za", "com.au", "net.au", "org.au", "com.br", "com.mx", "co.kr"]
BRANDS = ["paypal.com", "microsoft.com", "docusign.com", "google.com", "apple.com", "amazon.com", "dropbox.com", "office.com", "bankofamerica.com", "wellsfargo.com", "chase.com", "facebook.com", "netflix.com"]
BRAND_KEYWORDS = [*((d.split(".")[0], d) for d in BRANDS), ("bank of america", "bankofamerica.com"), ("wells fargo", "wellsfargo.com")]
CATEGORIES = {
    "CDN / Cloud Hosting": ["cloudflare.com", "cloudfront.net", "fastly.net", "akamai.net", "azureedge.net", "googleusercontent.com", "jsdelivr.net"],
    "File Sharing / Cloud Storage": ["dropbox.com", "drive.google.com", "onedrive.live.com", "sharepoint.com", "box.com", "wetransfer.com", "mega.nz"],
    "URL Shortener": ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "rebrand.ly"],
    "Payment Processor": ["paypal.com", "stripe.com", "squareup.com", "venmo.com", "payoneer.com"],
    "Social Media": ["facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "tiktok.com", "reddit.com"],
    "Code Repository / Paste Site": ["github.com", "gitlab.com", "bitbucket.org", "pastebin.com", "gist.github.com"],
    "Email Security Link-Rewrite Service": ["proofpoint.com", "safelinks.protection.outlook.com", "barracudanetworks.com", "cudasvc.com"],
    "Communication / Meeting Platform": ["zoom.us", "teams.microsoft.com", "meet.google.com", "webex.com", "slack.com"],
    "Email Service Provider": ["sendgrid.net", "amazonses.com", "mailgun.org", "mandrillapp.com", "mcsv.net", "rsgsv.net", "mcdlv.net", "sparkpostmail.com", "postmarkapp.com", "mailjet.com", "sendinblue.com", "brevo.com", "constantcontact.com", "createsend.com", "hubspotemail.net", "exacttarget.com", "klaviyomail.com"],
    "Suspicious / Free TLD": [".xyz", ".top", ".click", ".link", ".zip", ".mov"],
}
DOCUMENT_EXTENSIONS = ["pdf", "doc", "docx", "docm", "xls", "xlsx", "xlsm", "ppt", "pptx", "pptm", "odt", "odp", "rtf", "txt", "jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "svg", "webp", "zip"]
EXECUTABLE = "exe|scr|com|pif|bat|cmd|js|jse|vbs|vbe|wsf|wsh|ps1|psm1|hta|msi|msp|jar|lnk|dll|cpl|reg|chm|scf|inf|ocx|sys"
DOCUMENT = "pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|bmp|txt|rtf|csv|zip|html?"
MACRO = "docm|dotm|xlsm|xltm|xlam|pptm|potm|ppam|ppsm|sldm"
CONTAINER = "iso|img|vhd|vhdx"
INVISIBLE = r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
HIDDEN_CHARS = "\u00ad\u00a0\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\ufeff\u2060\u2061\u061c"
#: Host names that say nothing about who received a message.
LOCAL_HOST = r"^(?:localhost|localhost\.localdomain|unknown|127\.\d+\.\d+\.\d+|::1|0:0:0:0:0:0:0:1|.*\.local|.*\.localdomain|.*\.internal|.*\.lan)$"
#: Headers that a message has at most once.
SINGLE_HEADERS = ["from", "sender", "subject", "date", "message-id", "reply-to", "in-reply-to"]
RISKY_EXTENSIONS = [".exe", ".scr", ".js", ".vbs", ".bat", ".cmd", ".jar", ".ps1"]
URGENT_SUBJECT = ["urgent", "verify your account", "suspended", "action required", "password expires"]
HIDDEN_CSS = r"(?i)display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em|rem|%)?\s*(?:;|$)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)|mso-hide\s*:\s*all"
OFF_SCREEN = r"(?i)(?:^|;)\s*(?:left|top|right|bottom|text-indent|margin-left)\s*:\s*-\s*\d{3,}(?:px|em|pt|cm)"
TINY = r"(?i)font-size\s*:\s*1(?:\.0+)?px"
_WHITE = r"(?:#fff(?:fff)?|white|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))"
WHITE_TEXT = rf"(?i)(?:^|;)\s*color\s*:\s*{_WHITE}\s*(?:;|$|!)"
WHITE_GROUND = rf"(?i)(?:^|;)\s*background(?:-color)?\s*:\s*{_WHITE}\s*(?:;|$|!)"
#: Letters of the scripts that are confused with Latin, and of the others, as character classes.
SCRIPTS = {
    "latin": r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1e00-\u1eff",
    "cyrillic": r"\u0400-\u0481\u048a-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f",
    "greek": r"\u0370-\u0374\u0376-\u037d\u037f-\u0383\u0386\u0388-\u03ff\u1f00-\u1fff",
    "armenian": r"\u0530-\u0559\u0560-\u0588\u058b-\u058f",
    "hebrew": r"\u0590-\u05ff",
    "arabic": r"\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufefe",
    "devanagari": r"\u0900-\u097f",
    "thai": r"\u0e00-\u0e7f",
    "hangul": r"\uac00-\ud7af\u1100-\u11ff\u3130-\u318f",
    "han": r"\u4e00-\u9fff\u3400-\u4dbf\uf900-\ufaff",
    "hiragana": r"\u3040-\u309f",
    "katakana": r"\u30a0-\u30ff",
}
CONFUSABLE_SCRIPTS = ["latin", "cyrillic", "greek", "armenian"]
WEIGHTS = {"subject": 6, "url": 4, "from": 3, "to": 3, "replyto": 3, "returnpath": 3, "attachment": 3, "cc": 2, "bcc": 2, "ocr": 2}
