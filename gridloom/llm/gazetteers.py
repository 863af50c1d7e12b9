"""Fixed lists of the personal-data labelers: public facts, in plain form."""

# Providers of personal mailboxes.
MAIL_PROVIDERS = ("aol", "fastmail", "free", "freenet", "gmail", "gmx", "googlemail", "hotmail", "icloud", "laposte", "libero", "live", "mail", "me", "msn", "orange", "outlook", "posteo", "proton", "protonmail", "qq", "rediffmail", "sfr", "t-online", "telefonica", "tutanota", "wanadoo", "web", "yahoo", "yandex", "zoho")
# Generic top-level domains; any two letters are taken as a country's.
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "app", "dev", "cloud", "online", "site", "tech", "email", "museum", "travel")
# Country calling codes of one and two digits; the zones in which all others have three.
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
CALLING_ZONES = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "80", "85", "87", "88", "96", "97", "99")
# Lengths of bank account numbers (ISO 13616) by country.
IBAN_LENGTHS = {"AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}
# First digits of card issuers.
CARD_PREFIXES = ("34", "35", "36", "37", "38", "39", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "64", "65", "67")
# First parts of addresses that are handed out to hosts; 0, 127 and 224 to 255 aren't.
HOST_PARTS = tuple(str(k) for k in range(1, 224) if k != 127)
# Area codes that stand for services, not places (North America).
SERVICE_AREAS = ("211", "311", "411", "511", "611", "711", "800", "811", "833", "844", "855", "866", "877", "888", "900", "911")
# Beginnings of keys that services hand out, and names that keys and passwords are assigned to.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "hf_", "npm_", "eyJ")
SECRET_NAMES = ("password", "passwd", "passwort", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "auth_key", "private_key", "client_secret", "contraseña", "mot_de_passe")
# Given names that make a telephone number or address before or after them somebody's.
GIVEN_NAMES = ("Adam", "Ahmed", "Alex", "Alice", "Ana", "Andrea", "Anna", "Antonio", "Carlos", "Carmen", "Charlotte", "Chen", "Claire", "Daniel", "David", "Elena", "Emma", "Eva", "Fatima", "Felix", "Francesca", "George", "Hans", "Helen", "Ivan", "James", "Jane", "Jean", "Johann", "John", "José", "Julia", "Karl", "Laura", "Leon", "Lisa", "Louis", "Lucia", "Luis", "Marc", "Maria", "Marie", "Mark", "Martin", "Mary", "Max", "Michael", "Mohammed", "Nina", "Olga", "Pablo", "Paul", "Peter", "Pierre", "Robert", "Sara", "Sofia", "Stefan", "Susan", "Thomas", "Wei")
# Words that come before personal data, and before numbers of other kinds (English, German, French, Spanish).
CUES = ("mail", "contact", "phone", "tel", "call", "mobile", "cell", "fax", "card", "visa", "account", "iban", "bank", "ssn", "social", "address", "reach", "write", "host", "login", "server", "kontakt", "telefon", "anruf", "konto", "karte", "adresse", "courriel", "appel", "compte", "carte", "correo", "llam", "cuenta", "tarjeta", "direcci", "key", "credential", "password", "secret", "token")
COUNTER_CUES = ("order", "invoice", "version", "chapter", "section", "page", "item", "serial", "ticket", "isbn", "issn", "article", "no.", "fig", "bestell", "rechnung", "kapitel", "seite", "commande", "facture", "chapitre", "pedido", "factura", "capítulo", "página", "commit", "checksum", "sha")
