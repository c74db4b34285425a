"""Word lists, rules and patterns of the ticket domain.

Fixed values: results depend on these exact entries and on their order.
"""

from __future__ import annotations

#: Spelling to standard form, replaced in this order as whole words, ignoring case.
WORD_FORMS: list[tuple[str, str]] = [
    ("npwpd", "npwp"),
    ("npw", "npwp"),
    ("npwp15", "npwp"),
    ("npwp 15", "npwp"),
    ("npwp16", "npwp"),
    ("npwp 16", "npwp"),
    ("nik.", "nik"),
    ("no nik", "nik"),
    ("nop.", "nop"),
    ("no nop", "nop"),
    ("pph21", "pph 21"),
    ("pph22", "pph 22"),
    ("pph23", "pph 23"),
    ("pph25", "pph 25"),
    ("pph26", "pph 26"),
    ("pph4(2)", "pph 4 ayat 2"),
    ("pph final", "pph 4 ayat 2"),
    ("ppn11", "ppn"),
    ("ppnbm.", "ppnbm"),
    ("sptmasa", "spt_masa"),
    ("sptmasapajak", "spt_masa"),
    ("spttahunan", "spt_tahunan"),
    ("skpkb.", "skpkb"),
    ("skpkn", "skpn"),
    ("skplb.", "skplb"),
    ("stp.", "surat_tagihan_pajak"),
    ("efiling", "e_filing"),
    ("e filing", "e_filing"),
    ("efaktur", "e_faktur"),
    ("e faktur", "e_faktur"),
    ("ebilling", "e_billing"),
    ("e billing", "e_billing"),
    ("ebupot", "e_bupot"),
    ("e bupot", "e_bupot"),
    ("djponline", "djp_online"),
    ("djpon", "djp_online"),
    ("pbb-p2", "pbb"),
    ("bea materai", "bea meterai"),
    ("ar.", "ar"),
    ("acct rep", "ar"),
]

#: Pattern to standard term, replaced in this order, ignoring case.
TERM_PATTERNS: list[tuple[str, str]] = [
    (r"\bwp\b", "wajib_pajak"),
    (r"\bwpop\b", "wajib_pajak_orang_pribadi"),
    (r"\bwp op\b", "wajib_pajak_orang_pribadi"),
    (r"\bwp_badan\b", "wajib_pajak_badan"),
    (r"\bwp badan\b", "wajib_pajak_badan"),
    (r"\bbut\b", "bentuk_usaha_tetap"),
    (r"\bar\b", "account_representative"),
    (r"\bkpp\b", "kantor_pelayanan_pajak"),
    (r"\bkpp\s?pratama\b", "kantor_pelayanan_pajak_pratama"),
    (r"\bkpp\s?khusus\b", "kantor_pelayanan_pajak_khusus"),
    (r"\bkanwil\b", "kantor_wilayah"),
    (r"\bkanwil\s?djp\b", "kantor_wilayah_direktorat_jenderal_pajak"),
    (r"\bkp2kp\b", "kantor_pelayanan_penyuluhan_dan_konsultasi_perpajakan"),
    (r"\bdjp\b", "direktorat_jenderal_pajak"),
    (r"\bditjen pajak\b", "direktorat_jenderal_pajak"),
    (r"\bdirjen pajak\b", "direktur_jenderal_pajak"),
    (r"\bnpwp\b", "nomor_pokok_wajib_pajak"),
    (r"\bnik\b", "nomor_induk_kependudukan"),
    (r"\bnop\b", "nomor_objek_pajak"),
    (r"\bpph\b", "pajak_penghasilan"),
    (r"\bpph\s?21\b", "pajak_penghasilan_pasal_21"),
    (r"\bpph\s?22\b", "pajak_penghasilan_pasal_22"),
    (r"\bpph\s?23\b", "pajak_penghasilan_pasal_23"),
    (r"\bpph\s?25\b", "pajak_penghasilan_pasal_25"),
    (r"\bpph\s?26\b", "pajak_penghasilan_pasal_26"),
    (r"\bpph\s*4\s*(?:ayat\s*)?\(?\s*2\s*\)?\b", "pajak_penghasilan_pasal_4_ayat_2"),
    (r"\bppn\b", "pajak_pertambahan_nilai"),
    (r"\bppnbm\b", "pajak_penjualan_atas_barang_mewah"),
    (r"\bbkp\b", "barang_kena_pajak"),
    (r"\bjkp\b", "jasa_kena_pajak"),
    (r"\bspt\b", "surat_pemberitahuan"),
    (r"\bspt masa\b", "surat_pemberitahuan_masa"),
    (r"\bspt tahunan\b", "surat_pemberitahuan_tahunan"),
    (r"\bskp\b", "surat_ketetapan_pajak"),
    (r"\bskpkb\b", "surat_ketetapan_pajak_kurang_bayar"),
    (r"\bskpkbt\b", "surat_ketetapan_pajak_kurang_bayar_tambahan"),
    (r"\bskpn\b", "surat_ketetapan_pajak_nihil"),
    (r"\bskplb\b", "surat_ketetapan_pajak_lebih_bayar"),
    (r"\bstp\b", "surat_tagihan_pajak"),
    (r"\bsp2dk\b", "surat_permintaan_penjelasan_atas_data_dan_atau_keterangan"),
    (r"\bsse\b", "surat_setoran_elektronik"),
    (r"\bssp\b", "surat_setoran_pajak"),
    (r"\bnsfp\b", "nomor_seri_faktur_pajak"),
    (r"\bfaktur pajak\b", "faktur_pajak"),
    (r"\bpembetulan spt\b", "pembetulan_surat_pemberitahuan"),
    (r"\bpembetulan sk\b", "pembetulan_surat_ketetapan_pajak"),
    (r"\bkeberatan\b", "keberatan_pajak"),
    (r"\bkb\b", "keberatan_pajak"),
    (r"\bbanding\b", "upaya_hukum_banding"),
    (r"\bpk\b", "peninjauan_kembali"),
    (r"\bdjp online\b", "djp_online"),
    (r"\be-filing\b", "e_filing"),
    (r"\be-faktur\b", "e_faktur"),
    (r"\be-billing\b", "e_billing"),
    (r"\be-bupot\b", "e_bupot"),
    (r"\bsubjek pajak\b", "subjek_pajak"),
    (r"\bobjek pajak\b", "objek_pajak"),
    (r"\bmasa pajak\b", "masa_pajak"),
    (r"\btahun pajak\b", "tahun_pajak"),
    (r"\bdaerah pabean\b", "daerah_pabean"),
    (r"\blh\b", "lebih_bayar"),
    (r"\blb\b", "lebih_bayar"),
    (r"\bpkp\b", "pengusaha_kena_pajak"),
    (r"\bde\b", "status_dihapus"),
    (r"\bba\b", "berita_acara"),
]

#: Names that a tag in angle brackets may have; others count as OTHER.
TAG_NAMES = [
    "NPWP", "NIK", "NOP", "NAMA_WP", "NO_WP", "NO_DOKUMEN", "NO_SKP", "NO_CM", "NO_PC", "EMAIL", "TELP", "NO_HP",
    "URL", "IP", "IMEI", "IMSI", "ALAMAT", "KODE_POS", "NAMA", "USERNAME", "USER",
]

#: What is replaced by a typed placeholder, in this order, after tags.
PLACEHOLDERS: list[tuple[str, str]] = [
    ("URL", r"(?i)\bhttps?://\S+|\bwww\.\S+"),
    ("EMAIL", r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("LONGNUM", r"\b\d{8,}\b"),
]
TAG = r"(?i)<\s*([A-Z0-9_]+)\s*>"
HTML_TAG = r"<[^>]+>"

#: (label, token, pattern) of the redaction rules, in order.
REDACTIONS: list[tuple[str, str, str]] = [
    ("placeholder_tags", "<PLACEHOLDER>", r"(?i)<\s*(NPWP|NAMA_WP|NO_SKP|NO_DOKUMEN|NO_CM|NO_PC|NO_NIK|NIK|NOP)\s*>"),
    ("npwp", "<NPWP>", r"\b\d{2}\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}\b"),
    ("npwp", "<NPWP>", r"\b\d{15}\b"),
    ("nik", "<NIK>", r"\b\d{16}\b"),
    ("nop", "<NOP>", r"(?i)\bNOP\s*[:\-]?\s*[0-9\.\-]{10,30}\b"),
    ("doc_number", "<NO_DOKUMEN>", r"(?i)\b(no\.?|nomor)\s+(skp|sk|dokumen|dok|kasus|cm|pc)\s*[:\-]?\s*[A-Za-z0-9\/\.\-]+"),
    ("pc_code", "<NO_PC>", r"(?i)\b(?:PC|jodo)\s*[A-Za-z0-9_\-\.]{2,30}\b"),
    ("nama_wp", "<NAMA_WP>", r"(?i)(atas\s+wajib\s+pajak|nama\s+wp)\s+[A-Z0-9][A-Za-z0-9\.\s'\-]{2,60}"),
    ("email", "<EMAIL>", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("url", "<URL>", r"https?://\S+"),
    ("phone", "<NO_TELP>", r"\b(?:\+62|62|0)\d{8,13}\b"),
]

#: (name, pattern) of the wider redaction set, in order. NAMA_WP keeps its first group.
WIDE_REDACTIONS: list[tuple[str, str]] = [
    ("NAMA_WP", r"(?i)\b(nama\s*(?:wajib\s*pajak|wp)\s*[:\-]?\s*)([A-Z][A-Za-z .'\-]{2,})"),
    ("URL", r"\b(?:https?://|www\.)[^\s]+"),
    ("EMAIL", r"\b[\w\.-]+@[\w\.-]+\.\w+\b"),
    ("IP", r"\b(?:(?:\d{1,3}\.){3}\d{1,3})\b"),
    ("MAC", r"\b(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}\b"),
    ("PHONE", r"\b(?:\+62|62|0)8\d{8,12}\b"),
    ("NPWP", r"(?i)\b(?:npwp[:\-\s]*)?(?:\d{2}\.?\d{3}\.?\d{3}\.?\d{1}-?\d{3}\.?\d{3}|\d{15})\b"),
    ("DOCNO", r"(?i)\b(?:no\.?|nomor|doc(?:ument)?|surat)\s*[:\-]?\s*[A-Z0-9/\-\.]{4,}\b"),
    ("DOCPAT", r"\b[0-9]{1,4}/[A-Z0-9.\-]{2,}/[0-9]{2,4}\b"),
    ("TICKET", r"\b(?:INC|REQ|PRB|CHG)[-_]?\d{4,}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}\-[0-9a-fA-F]{4}\-[1-5][0-9a-fA-F]{3}\-[89abAB][0-9a-fA-F]{3}\-[0-9a-fA-F]{12}\b"),
    ("GITHASH", r"\b[0-9a-f]{7,40}\b"),
    ("WINPATH", r"\b[A-Za-z]:\\[^\s]+"),
    ("UNIXPATH", r"(?<!\w)/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+"),
]

#: Greetings and thanks that are cut before tokens are taken.
STOP_PHRASES = [
    r"\bterima\s*kasih\b",
    r"\bterima\s*ksh\b",
    r"\btrimakasih\b",
    r"\bterimakasih\b",
    r"\bmohon\s*bantu(annya)?\b",
    r"\bdengan\s*hormat\b",
    r"\bselamat\s*pagi\b",
    r"\bselamat\s*siang\b",
    r"\bselamat\s*sore\b",
    r"\bselamat\s*malam\b",
    r"\bass?alamualaik(um)?\b",
    r"\bwaalaikumsalam\b",
]

#: Words that are dropped; the negation tidak is not among them.
STOP_WORDS = [
    "selamat", "pagi", "siang", "sore", "malam", "assalamualaikum", "waalaikumsalam", "salam", "mohon", "minta",
    "tolong", "bantu", "dibantu", "bantuannya", "izin", "ijin", "permisi", "harap", "kiranya", "sekiranya", "terima",
    "kasih", "terimakasih", "makasih", "thanks", "thank", "thx", "dengan", "hormat", "yang", "kami", "saya", "anda",
    "bapak", "ibu", "pak", "bu", "sdh", "sudah", "apakah", "dimana", "kapan", "bagaimana", "kenapa", "mengapa",
    "sehubungan", "terkait", "perihal", "mengenai", "tentang", "berikut", "sebagai", "adalah", "yaitu", "yakni",
    "agar", "mau", "ingin", "akan", "bisa", "nomor_pokok_wajib_pajak", "nomor_induk_kependudukan",
]

#: Words that stay even where they are stop words.
KEEP_WORDS = [
    "error", "gagal", "login", "lupa", "reset", "otp", "email", "nomor", "sertifikat", "password", "verifikasi",
    "npwp", "nik", "nop", "spt", "sse", "ssp", "sp2dk", "pph", "ppn", "ppnbm", "e_faktur", "e_billing", "e_filing",
    "djp_online",
]

#: Words that the frequency reports leave out.
REPORT_STOP_WORDS = [
    "yang", "dan", "atau", "di", "ke", "dari", "dengan", "untuk", "pada", "dalam", "ada", "tidak", "jadi", "ini",
    "itu", "karena", "sudah", "hingga", "agar", "oleh", "saat", "seperti", "mohon", "tersebut", "kami", "saya",
    "bapak", "ibu", "dapat", "akan", "jika", "sebagai", "juga", "atas", "kpd", "terima", "kasih", "wp", "npwp",
    "djp",
]

#: Texts that say nothing.
MEANINGLESS = [
    "tes", "test", "test1", "test 1", "cek", "coba", "uji", "ujicoba", "uji coba", "abc", "xx", "ok", "....", "...",
    "..", "--", "---", "??", "?",
]
