"""Phrases by which pages label a date as its update or its publication."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, fold, fold_str, let

# Labels of an update, by language.
MODIFIED = """
last updated; updated on; updated at; last modified; last revised; revised on; edited on; last edited; updated; modified; date of last revision; last revision; revision date; last reviewed
ultimo aggiornamento; aggiornato il; aggiornato al; modificato il; aggiornato
zuletzt aktualisiert; aktualisiert am; letzte anderung; geandert am; aktualisiert
mis a jour le; derniere mise a jour; modifie le; mis a jour
ultima actualizacion; actualizado el; actualizado
atualizado em; ultima atualizacao; atualizado
laatst bijgewerkt; bijgewerkt op; bijgewerkt
senast uppdaterad; uppdaterad; sist oppdatert; oppdatert; senest opdateret; opdateret
paivitetty; viimeksi paivitetty
ostatnia aktualizacja; zaktualizowano; aktualizacja
aktualizovano; posledni aktualizace
обновлено; последнее обновление; изменено
оновлено; останнє оновлення
son guncelleme; guncellendi
τελευταια ενημερωση; ενημερωθηκε
ultima actualizare; actualizat
frissitve; utoljara frissitve
terakhir diperbarui; diperbarui
最后更新; 更新于; 更新时间; 最後更新
最終更新; 更新日
최종 수정; 수정일; 업데이트
آخر تحديث; تم التحديث
עודכן לאחרונה; עודכן
अंतिम अपडेट; अपडेट किया गया
"""
# Labels of a publication, by language.
PUBLISHED = """
published on; published at; first published; originally published; posted on; posted at; date published; published; posted
pubblicato il; data di pubblicazione; pubblicato
veroffentlicht am; veroffentlicht; erstellt am; erschienen am; geschrieben am; geschrieben; verfasst am; verfasst; gepostet am; gepostet
publie le; date de publication; publie
publicado el; fecha de publicacion; publicado
publicado em; data de publicacao; publicado
gepubliceerd op; geplaatst op; gepubliceerd
publicerad; publisert; offentliggjort
julkaistu
opublikowano; data publikacji
publikovano; zverejneno
опубликовано; дата публикации; размещено
опубліковано; дата публікації
yayinlanma tarihi; yayimlandi; yayinlandi
δημοσιευθηκε; ημερομηνια δημοσιευσης
publicat pe; publicat
kozzeteve; publikalva
dipublikasikan; diterbitkan
发布于; 发表于; 发布时间; 發佈於; 發表於
公開日; 投稿日; 掲載日
게시일; 작성일; 발행일
تاريخ النشر; نشر في; نشرت
תאריך פרסום; פורסם
प्रकाशित; प्रकाशन तिथि
"""


@cache
def pattern(kind: str) -> str:
    """Any label of the kind, the longest first, for folded text."""
    phrases = {fold_str(p.strip()) for line in (MODIFIED if kind == "modified" else PUBLISHED).strip().splitlines() for p in line.split(";")}
    return any_of(sorted(phrases))


def folded_field(folded: Column) -> Column:
    """modified if an update's label stands in the folded text, else published or unknown."""
    return F.when(folded.rlike(f"(?iu){pattern('modified')}"), "modified").when(folded.rlike(f"(?iu){pattern('published')}"), "published").otherwise("unknown")


def field_from_label(text: Column) -> Column:
    """The same for a text as it stands."""
    return let(fold(text), folded_field)
