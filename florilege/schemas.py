"""Schemas of the tables between stages, as DDL."""

from __future__ import annotations

CORPUS = "text string not null, timestamp string, url string"
SENTENCES = "sentence_id string, file_path string, doc_i bigint, sent_i int, text string, tokens array<string>, url string"
TOKEN = "struct<i:int,text:string,lower:string,pos:string,tag:string,dep:string,head:int,is_space:boolean,like_email:boolean>"
ENTITY = "struct<start:int,end:int,text:string,label:string>"
ANNOTATIONS = f"sentence_id string, toks array<{TOKEN}>, ents array<{ENTITY}>"
MATCHES = "sentence_id string, node_id string, match_text string, match_start int, match_end int"
GENERIC = "sentence_id string, is_generic boolean"
LABELS = "sentence_id string, scores map<string,double>"
CLUSTERS = "node_id string, cluster_rank int, sentence_ids array<string>"
CLUSTERS_WITH_REPS = "node_id string, cluster_id string, sentence_ids array<string>, rep string"
NODES = "node_id string, parent_id string, level int, name string, short_name string, population bigint"
ALIASES = "alias string, node_id string"
ASSERTIONS = (
    "id string, subject string, domain string, rep string, size int, prob double, tf double, idf double, noun_density double, has_subjects int, combined_score double, "
    "sentences array<struct<text:string,url:string>>, aspect string, concepts array<string>, masked_sentence string, tokens array<string>, matches array<struct<text:string,start:int,end:int>>"
)
PLACES = (
    "geonameid string, name string, asciiname string, alternatenames string, latitude string, longitude string, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population string, elevation string, dem string, timezone string, modified string"
)
ALTERNATE_NAMES = "alternate_name_id string, geoname_id string, iso_language string, alternate_name string, is_preferred string, is_short string, is_colloquial string, is_historic string, from_date string, to_date string"
HIERARCHY = "parent_id string, child_id string, type string"
ADMIN_CODES = "code string, name string, ascii_name string, geoname_id string"
