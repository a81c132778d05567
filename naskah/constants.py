"""Fixed values. Results depend on these exact words, patterns and numbers."""

# --- orthography rules -------------------------------------------------------

# Place words after "di".
LOCATIVES = """
atas bawah dalam luar mana antara samping sebelah depan belakang tengah pinggir puncak ujung
pojok sudut sekitar sekeliling balik hadapan tepi sini sana situ tempat rumah sekolah kantor
kelas kamar gedung aula jalan kota desa kampus kampung fakultas jurusan asrama hotel bandara
stasiun terminal pelabuhan klinik apotek pabrik kantin pasar taman lapangan masjid gereja
restoran toko ruang pusat kafe warung rumahnya sekolahnya kantornya
""".split()

# Verbs whose passive "di-" is written together.
PASSIVE_VERBS = """
bawa lihat beli pakai buat baca tulis dengar kenal jaga lempar putar jual ambil taruh hapus
ganti suruh kasih simpan kirim tangkap ucap anggap pikir panggil pegang kira terima capai ajar
latih gunakan lakukan pakaikan bawakan berikan jelaskan sampaikan tunjukkan sebutkan jadikan
sediakan kerjakan terapkan lupakan pelajari datangi hadiri lalui akhiri mulai taati tutupi
dukung tetapkan arahkan jalankan matikan hidupkan tinggalkan biarkan temukan analisis analisa
evaluasi observasi identifikasi klasifikasi verifikasi validasi kategorikan klasifikasikan
tampilkan hasilkan simpulkan rumuskan analisiskan lakukannya gunakannya
""".split()

# Words that keep "pun" attached.
PUN_FIXED = """
adapun andaipun ataupun bagaimanapun biarpun jikapun kalaupun kendatipun maupun meskipun
sekalipun sementangpun sungguhpun walaupun
""".split()

# Section words written in capitals, never acronyms.
SECTION_WORDS = """
DAFTAR ISI TABEL GAMBAR BAB LANDASAN BAGIAN PASAL LAMPIRAN HALAMAN HASIL PUSTAKA METODE TEORI
KAJIAN ABSTRAK ABSTRACT PENUTUP SARAN TUJUAN MANFAAT MASALAH BATASAN ANALISIS DASAR LATAR KATA
LEMBAR RIWAYAT HIDUP PRAKATA SISTEM TERKAIT KINERJA SOLUSI EVALUASI PENGESAHAN
""".split()

# Acronyms that need no explanation.
UNIVERSAL_ACRONYMS = """
RI DPR MPR MK MA KPK BPK KPU TNI POLRI PNS ASN BIN KPI PBB PMI MUI NU UU BPS BNN BNPB BMKG BPN
BPJS BPKP BPOM SD SDN SMP SMPN SMA SMAN SMK SMKN MI MIN MTS MTSN MAN NIK SARA S1 S2 S3 D1 D2 D3
D4 PT PTN PTS KKN OSIS PMR PJOK PKK KHS KRS SKS IPK UTS UAS UN UNBK UTBK NIM NIP NRP NUPTK NPSN
AI ML NLP AR VR XR IT TI CPU GPU RAM ROM SSD HDD USB OS UI UX API SDK CLI GUI IDE URL HTML CSS
XML JSON YAML PDF DOC DOCX HTTP HTTPS TCP UDP IP FTP SSH TLS SSL SQL JS TS CSV JPG JPEG PNG GIF
SVG MP3 MP4 AVI WAV DNS CDN VPN LAN WAN WLAN DNA RNA GPS GIS CAD CAM KTP SIM STNK NPWP KK KIA
KIS PIN ATM CV UD BUMN BUMD LSM WHO UNICEF UNESCO EU ASEAN USA UK ISO IEEE ACM WIPO GMT UTC WIB
WIT WITA AM PM TV AC DC OK ID NO CEO CFO CTO COO HRD DOI ISBN ISSN ORCID
""".split()

# --- citations ---------------------------------------------------------------

# First words that never start an author.
AUTHOR_BLACKLIST = """
Abstrak Bab Daftar Gambar Hal Halaman Hasil Hlm Judul Kajian Kesimpulan Metode Nama No Nomor
Pembahasan Penelitian Penulis Pustaka Saran Tabel Tahun Tujuan Android Application Based Compose
Computer Development Digital Educational Evaluation Interactive Jetpack Journal Kotlin Learning
Media Menggunakan Mobile Model Pembelajaran Pengembangan Rancang Research Review Studi Teaching
Technology Using Jakarta Malang Surabaya Tulungagung
""".split()

# Headings that open a bibliography.
BIBLIOGRAPHY_HEADINGS = [
    r"daftar\s+pustaka",
    r"daftar\s+referensi",
    "bibliography",
    "kepustakaan",
    "references?",
    "referensi",
]

# --- passages ----------------------------------------------------------------

# Words left out of lexical tokens.
STOPWORDS = """
the a an of and or to in on at by for is are was were be been being that this these those it as
with from but not no yang dan atau di ke dari pada untuk dengan ini itu adalah ialah akan sudah
telah juga bahwa
""".split()

# Abbreviations that do not end a sentence.
ABBREVIATIONS = """
mr mrs ms dr prof st mt sr jr e.g i.e cf vs etc al fig eq ref ch pp p bpk ibu sdr tn ny kk yth
dst dll hal mis tsb spt tgl no jl
""".split()

# Signals of a masthead or title page, as (pattern, ignore case).
FRONT_MATTER_SIGNALS = [
    (r"\bE[\s-]?ISSN\b", True),
    (r"\bISSN\b", True),
    (r"\bISBN\b", True),
    (r"\bDOI\s*:?\s*10\.", True),
    (r"\bVol(?:ume)?\.?\s*\d+", True),
    (r"\bNo(?:mor)?\.?\s*\d+", True),
    (r"\b[\w.-]+@[\w.-]+\.[A-Za-z]{2,}\b", False),
    (r"\bA\s*B\s*S\s*T\s*R\s*A\s*K\b", False),
    (r"\bA\s*B\s*S\s*T\s*R\s*A\s*C\s*T\b", False),
]
# Openers of the body text, tried in this order; case is ignored.
BODY_OPENERS = [
    r"P\s*E\s*N\s*D\s*A\s*H\s*U\s*L\s*U\s*A\s*N",
    r"I\s*N\s*T\s*R\s*O\s*D\s*U\s*C\s*T\s*I\s*O\s*N",
    r"L\s*a\s*t\s*a\s*r\s+B\s*e\s*l\s*a\s*k\s*a\s*n\s*g",
]

BM25_K1, BM25_B = 1.2, 0.75
WINDOW_SENTENCES, WINDOW_STRIDE = 3, 1
NGRAM_WORDS = 8
CANDIDATE_PAGES = 10
PASSAGE_ACCEPT = 0.42
PASSAGE_MARGIN = 0.015
TOKEN_RATE_ANCHOR = 0.2
# Lowest accepted cosine per embedding model.
COSINE_FLOORS = {
    "paraphrase-minilm-l12-v2": 0.55,
    "multilingual-e5-small": 0.78,
    "multilingual-e5-base": 0.78,
}
COSINE_FLOOR_OTHER = 0.7
TITLE_ACCEPT = 0.35

# --- dictionary --------------------------------------------------------------

# Prefix rules, tried in this order (pattern, replacement).
PREFIX_RULES = [
    ("^meng(?=[aeiou])", ""),
    ("^meny([aeiou])", r"s\1"),
    ("^meng([aeiou])", r"k\1"),
    ("^peng([aeiou])", r"k\1"),
    ("^mem([aeiou])", r"p\1"),
    ("^pem([aeiou])", r"p\1"),
    ("^men([aeiou])", r"t\1"),
    ("^pen([aeiou])", r"t\1"),
    ("^me[mnlry]?([a-z])", r"\1"),
    ("^me([a-z])", r"\1"),
    ("^di([a-z])", r"\1"),
    ("^ber([a-z])", r"\1"),
    ("^be([a-z])", r"\1"),
    ("^ter([a-z])", r"\1"),
    ("^te([a-z])", r"\1"),
    ("^per([a-z])", r"\1"),
    ("^pe([a-z])", r"\1"),
    ("^se([a-z])", r"\1"),
    ("^ke([a-z])", r"\1"),
    ("^peng([a-z])", r"\1"),
    ("^pen([a-z])", r"\1"),
    ("^pem([a-z])", r"\1"),
    ("^pel([a-z])", r"\1"),
]
# Suffixes, tried in this order; a letter a-z must stand before them.
SUFFIXES = ["kan", "an", "i", "nya", "lah", "kah", "mu", "ku"]

# --- operations --------------------------------------------------------------

OUTCOMES = ["success", "http_error", "network_error", "timeout", "aborted"]
ERROR_OUTCOMES = ["http_error", "network_error", "timeout"]
IN_FLIGHT = ["pending", "found", "downloading", "extracting"]
STALE_SECONDS = 120
MAX_ATTEMPTS = 3
ANSWER_TTL_SECONDS = 15 * 60
DEFAULT_PAUSE_SECONDS = 60
MAX_PAUSE_SECONDS = 24 * 3600
DENSITY_PENALTY = 14
LOW_DENSITY_CHARS = 50
SUCCESS_PREVIEW, ERROR_PREVIEW = 2 * 1024, 1024 * 1024
