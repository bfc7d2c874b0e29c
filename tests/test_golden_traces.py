"""Replay of a whole dump of tokens: every candidate that is a known headword, in order, and the order of the report."""

from kataflow.operators import candidates as C
from kataflow.operators import resolve

# A line per token with all its hits among all hits of all lines ("!": none), in the order of the file.
TRACES = """
ngekill !
trus !
mempertidakbertanggungjawabkannya !
dirikan, dirikan, merikan, diri, rik, ri, dir, mengerik, r
berikan, berikan, ikan, beri, berik, rik, i, ik
diberikan, diberikan, memberikan, berikan, diberi, ikan, beri, berik, memberi, rik, i, ik
pemberian, pemberian, berian, pemberi, rian, ian, beri, i
mengunyah, mengunyah, kunyah, nyah, mengesah, cah, sah
menggali, menggali, gali, gal
mengali, mengali, ali, kali, mengekali, kal, al
menyapu, menyapu, sapu, apu
meraba, meraba, raba
kebijaksanaanmulah, kebijaksanaan, bijaksana, terbijaksana
nenekkulah, nenek
mengecek, mengecek, cek
ngocok, ngocok, mengocok, kocok
mengobrol, mengobrol, obrol
menonton, menonton, tonton
ngecek, ngecek, mengecek, cek
tanya, tanya
hanya, hanya
mengaba-aba, mengaba-aba, aba, kaba
muntahkanlah, memuntahkan, muntah, memuntah
mempertahankan, mempertahankan, pertahankan, menahankan, tahan, tah
kasihan, kasihan, kasih
diamlah, diamlah, diam, am
diriku, diriku, diri, ri, dir, r
kutanya, kuta, tanya
maham, membaham, paham, baham
mahami, memahami, pahami, paham, baham, membaham
nyoba, nyoba, mencoba, coba, soba
nanyanya, nanya, menanya, tanya
memperbaikinya, memperbaiki, perbaiki, membaiki, baik
kuperbaikinya, perbaiki, memperbaiki, membaiki, baik
ketidakmampuannya, ketidakmampuan, mampu
kesalahpahaman, kesalahpahaman
ketidakberuntungan, ketidakberuntungan, beruntung, runtung, untung, runtungan
disini, disini, sini, disin, sin, diskan, si, dis, s, sk
kerumahku, rumah
nemuin, nemuin, menemukan, menemui, temukan, temui, temu, cemuk, menjemukan, jemu, menemu, mencemuk
memasakan, asakan, memasak, pasa, pasak, asa, asak
nyobain, nyobain, mencobakan, mencobai, nyoba, coba, cobak, soba, mencoba
gaada, ada
akupun, aku
kemanapun, kemanapun, kemana, manapun, mana, pana, bana
kemana-mana, kemana-mana, mana, kemana, mana-mana, pana, bana
ngasih, ngasih, mengasih, asih, kasih
ngasih-ngasih, ngasih, mengasih, asih, kasih
tulis-menulis, tulis-menulis, tulis
setinggiku, setinggi, tinggi, meninggi
setinggi-tingginya, setinggi-tingginya, tinggi, setinggi, meninggi
kutukan, kutukan, tukan, kutu, kutuk, tuk
menyia-nyiakan, menyia-nyiakan, sia, cia, ia
takkan, takkan, tak
sia-sia, sia-sia, sia
menyia-nyiakanmu, sia, cia, ia
menara, menara, tara, ara
setaranya, setara, tara
berkewarganegaraan, berkewarganegaraan, kewarganegaraan, warganegara
semengherankan, mengherankan, herankan, mengheran, heran, her, kher
temen, temen, teman, tem
cepet, cepet
ngebucin, bucin, buci
sampe, sampe
nyelesainnya, selesai, lesakan, selesa, lesa, lesak
nyelesaiinnya, nyelesaiin, menyelesaikan, selesaikan, selesai, selesa, lesa
memfitnah, memfitnah, fitnah
memvonis, memvonis, vonis
pemfitnah, pemfitnah, fitnah
pemvonis, pemvonis, vonis
memfasilitasi, memfasilitasi, fasilitasi, fasilitas
mengetahui, mengetahui, tahui, menahui, tahu
mengejar, mengejar, jar
mengekor, mengekor, kor
mengerjakan, mengerjakan
dinding, dinding, mending
dinas, dinas, mengenas, nas
dirgantara, dirgantara
kebuka, kebuka, terbuka, buka
ketutup, ketutup, tertutup, tutup
keliatan, keliatan, liat
kebaikan, kebaikan, baik, baikan, kebai, terbaik, bai, keba, ba, rba
kematian, kematian, mati, mengemati, pati, bati, mat, kemat, pat, bat
keadaan, keadaan, ada, adaan, terada, rada
kepala, kepala, pala
kelapa, kelapa, lapa
sebaiknya, sebaiknya, sebaik, baiknya, baik
apapun, apapun, apa
siapapun, siapapun, siapa
ampun, ampun
adapun, adapun, ada
walaupun, walaupun, walau
nyuci, nyuci, mencuci, cuci, suci
ngambil, ngambil, mengambil, ambil, kambil
nulis, nulis, menulis, tulis
mukul, mukul, memukul, pukul
nama, nama, tama, cama
mata, mata, memata, membata, pata, bata
ngeri, ngeri, mengeri, ri, nger
nyata, nyata, menyata, cata, sata
ngekatain, mengatakan, mengatai, katakan, katai, kata, katak, mengata, mengatak
ngecat, mengecat, cat
ngebaca, ngebaca, membaca, baca
ngekos, ngekos, mengekos, kos
ngesot, ngesot, mengesot
membacai, membacai, bacai, membaca, baca
mengirimi, mengirimi, kirimi, mengirim, irim, kirim
seni, seni, ni, sen, n
hari, hari, har
nasi, nasi, tasi, dasi, nas, tas, cas, das, jas
terasa, terasa, rasa, asa
perasa, perasa, rasa, asa
berencana, berencana, rencana
bermain, bermain, main, makan, mak, berma, mai, bain, memakan, pakan, ma, pai, bai, pak, bak
terbuka, terbuka, buka
pergi, pergi, gi, g
perlu, perlu, lu
ternyata, ternyata, nyata, menyata, cata, sata
terima, terima, rima, ima
berita, berita, rita, ita
aja, aja
tiba2, tiba-tiba, tiba
nyari, nyari, mencari, menyari, cari, sari, car, sar
ngehindar, menghindar, hindar
temen2, temen, teman-teman, teman, tem
ngerubah, merubah, rubah
abis, abis
dikelas, mengelas, kelas, las
nyamperin, nyamperin, menyamperi, samper, menyamper
ngajak, ngajak, mengajak, ajak
beraniin, beranikan, anik, berani, rani, ani, ran, an
dibarisan, barisan, baris, membaris
ap2, ap
gara2, gara-gara, gara
masi, masi, membasi, mengemasi, pasi, basi, mas, pas, bas
tau, tau
diratakan, diratakan, meratakan, ratakan, rata, ratak, merata
menggarukkan, menggarukkan, menggaruk, garuk, mengerukkan, ruk
menggarukan, garukan, menggaru, menggaruk, rukan, garu, garuk, ruk
mengarukkan, mengaruk, aruk, karuk
mengarukan, mengaru, mengaruk, aru, aruk, karu, karuk
memogokkan, memogokkan, mengogokkan, ogok
ngecrash, crash
sekitaran, kitaran, sekitar, kitar
anak-anaknya, anak
teman-temannya, teman, tem
bertanggung, tanggung
bertanggung-jawab, tanggung
produk-produk, produk
data-data, data
ngatain, ngatain, mengatakan, katakan, mengatai, katai, ata, atak, kata, katak, mengatak
perikanan, perikanan, ikanan, ikan, peri, rik, i, per, ik
memperbarui, memperbarui, perbarui, memperbaru, barui, perbaru, membarui, baru
mengikat, mengikat, ikat
"""
LINES = [(x.removesuffix(" !"), []) if x.endswith(" !") else (x.split(", ")[0], x.split(", ")[1:]) for x in TRACES.split("\n")[1:-1]]
# The tokens in the order of the report over all files.
REPORT = """mempertidakbertanggungjawabkannya ngekill trus abis adapun aja akupun ampun anak-anaknya ap2 apapun beraniin berencana berikan
berita berkewarganegaraan bermain bertanggung bertanggung-jawab cepet data-data diamlah dibarisan diberikan dikelas dinas dinding diratakan
dirgantara dirikan diriku disini gaada gara2 hanya hari kasihan keadaan kebaikan kebijaksanaanmulah kebuka kelapa
keliatan kemana-mana kemanapun kematian kepala kerumahku kesalahpahaman ketidakberuntungan ketidakmampuannya ketutup kuperbaikinya kutanya kutukan maham
mahami masi mata memasakan membacai memfasilitasi memfitnah memogokkan memperbaikinya memperbarui mempertahankan memvonis menara mengaba-aba
mengali mengarukan mengarukkan mengecek mengejar mengekor mengerjakan mengetahui menggali menggarukan menggarukkan mengikat mengirimi mengobrol
mengunyah menonton menyapu menyia-nyiakan menyia-nyiakanmu meraba mukul muntahkanlah nama nanyanya nasi nemuin nenekkulah ngajak
ngambil ngasih ngasih-ngasih ngatain ngebaca ngebucin ngecat ngecek ngecrash ngehindar ngekatain ngekos ngeri ngerubah
ngesot ngocok nulis nyamperin nyari nyata nyelesaiinnya nyelesainnya nyoba nyobain nyuci pemberian pemfitnah pemvonis
perasa pergi perikanan perlu produk-produk sampe sebaiknya sekitaran semengherankan seni setaranya setinggi-tingginya setinggiku sia-sia
siapapun takkan tanya tau teman-temannya temen temen2 terasa terbuka terima ternyata tiba2 tulis-menulis walaupun"""


def test_every_line():
    known = {h for _, hits in LINES for h in hits}
    got = [(t, [r[2] for r in C.candidates(t) if r[2] in known]) for t, _ in LINES]
    assert len(LINES) == 154 and got == LINES


def test_report(spark):
    tokens = spark.createDataFrame([("file.txt", k, t) for k, (t, _) in enumerate(LINES)], "file string, line_no long, token string")
    words = spark.createDataFrame([(h, ["x"]) for h in sorted({h for _, hits in LINES for h in hits})], "headword string, sources array<string>")
    made = C.generate(tokens)
    line = {t: ", ".join([t, *hits]) if hits else f"{t} {resolve.FATAL}" for t, hits in LINES}
    by_file = resolve.by_source(resolve.traces(tokens, made, words)).collect()
    assert [r.line for r in by_file] == [line[t] for t, hits in LINES if not hits] + [line[t] for t, hits in LINES if hits]
    combined = resolve.combined(resolve.traces(resolve.first_per(tokens, ["token"], ["file", "line_no"]), made, words)).collect()
    assert [r.token for r in combined] == REPORT.split() and [r.line for r in combined] == [line[t] for t in REPORT.split()]
    assert sorted(resolve.traces_by_token(made, words).select("token", "line").collect()) == sorted((t, x) for t, x in line.items())
