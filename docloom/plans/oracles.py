"""The queries of `queries` as SQL. Absent are those over file metadata (src3, src9)."""

from __future__ import annotations

from docloom.functions import fixed_values as fv
from docloom.plans.view_sql import (
    BLANKS,

    HEADER,
    ITINERARY,
    PRICING,
    VALID,
    base_name,
    case_of,
    filled,
    has,
    header_test,
    keywords,
    listed,
    lowered,
    magic,
    matches,
    nonzero,
    quoted,
    suffix,
    tokens,
    with_views,
)

def rows_text(column: str) -> str:
    cells = "array_to_string(list_transform(r, lambda c: coalesce(c, '~')), '|')"
    return f"array_to_string(list_transform({column}, lambda r: case when r is null then '~' else {cells} end), '/')"

def sorted_text(values: str) -> str:
    return f"array_to_string(list_sort({values}), ' ')"

def ngrams(words: str, n: int) -> str:
    return (
        f"array_to_string(list_transform(range(1, len({words}) - {n - 2}), lambda i:"
        f" array_to_string({words}[i:i + {n - 1}], '_')), ' ')"
    )

def table_test(test: str) -> str:
    return f"select table_id, coalesce({test}, false) as matches from v_clean"

# first-seen order, which list_distinct does not keep
ORDERED = "list_filter(all_words, lambda w, i: list_position(all_words, w) = i)"

FILLED13 = " + ".join(
    f"({test})::int"
    for test in [
        filled("name"), filled("description"), filled("category"),
        "(base_price is not null or discount_price is not null)", "details_kind = 0", has("itinerary"),
        has("inclusions"), has("exclusions"), filled("cancellation_policy"), filled("payment_policy"),
        filled("travel_info"), has("faqs"), has("tags"),
    ]
)
EDITOR13 = " + ".join(
    f"({test})::int"
    for test in [
        filled("name"), f"{filled('description')} and length(description) > 20", filled("category"), nonzero("base_price"),
        "details_kind = 0", has("itinerary"), has("inclusions"), has("exclusions"), filled("cancellation_policy"),
        filled("payment_policy"), filled("travel_info"), has("faqs"), "len(tags) > 1",
    ]
)
FINDING = "f.field as field, f.error_type as error_type, f.message as message, f.severity as severity"
CONTEXT = """string_agg('[Document: ' || {name} || ', Page ' || page_number || ']' || chr(10) || {body},
    chr(10) || chr(10) order by rank)"""

_SQL: dict[str, str] = {
    # sources and sinks
    "src4_profile_json": "select profile_id, job_id, business_type, name, email, city from v_profiles",
    "src5_discovery_store": "select job_id, path, file_type, file_size from v_files",
    "src6_files_by_category": "select category, job_id, path, file_size from v_files",
    "src7_export": """
        select profile_id, ordinal, max(kv.value) filter (kv.key = 'name') as name, null::varchar as internal,
            (count(*) - 1)::bigint as keys from v_item_maps group by 1, 2""",
    "src8_csv_rows": """
        select c_name as name, c_mktsegment || case when c_custkey % 7 = 0 then chr(10) || ', ' || c_name else '' end as segment,
            3::bigint as n_cells, null::bigint as row_index from customer
        union all select s_name, s_name || ' Ltd', 5, row_number() over (partition by s_suppkey // 100 order by s_suppkey) - 1 from supplier""",
    # manifest and files
    "fil1_archive_limits": """
        select job_id, archive_size, members, unpacked_bytes, reject_reason from v_checked
        union all select 'archive_' || s_suppkey, 1000, (s_suppkey % 3 = 2)::bigint, case when s_suppkey % 3 = 2 then 9 end,
            case when s_suppkey % 3 = 0 then 'invalid or corrupted archive' end from supplier""",
    "fil2_safe_path": "select job_id, member_path, path from v_paths",
    "fil3_member_errors": """
        select job_id, member_path, case when path is null then 'Skipped dangerous path: ' || member_path
            else 'Empty file: ' || path end as error from v_paths
        where path is null or (not ends_with(member_path, '/') and member_size <= 0)
        union all select 'archive_' || s_suppkey, case when s_suppkey % 3 = 2 then 'docs/a.pdf' end,
            case when s_suppkey % 3 = 2 then 'unreadable member: bad checksum' else 'invalid or corrupted archive: no directory' end
        from supplier where s_suppkey % 3 <> 1""",
    "fil4_type_by_extension": f"""
        select path, {suffix('path')} as extension, {case_of(fv.TYPE_BY_EXTENSION, suffix('path'))} as file_type
        from v_paths where path is not null""",
    "fil5_type_by_mime": f"select member_path, sniffed_mime, {case_of(fv.TYPE_BY_MIME, 'sniffed_mime')} as file_type from v_members",
    "fil6_type_by_magic": f"select member_path, {HEADER} as header, {magic('member_path')} as file_type from v_members",
    "fil7_classify": f"""
        select job_id, path, file_type, case when file_type <> 'unknown' then
            coalesce(case when {case_of(fv.TYPE_BY_MIME, 'sniffed_mime')} is not null then sniffed_mime end,
            {case_of(fv.MIME_BY_EXTENSION, suffix('path'))}) end as mime_type from v_typed""",
    "fil8_category": """
        select job_id, path, case when file_type in ('pdf', 'doc', 'docx') then 'document'
            when file_type in ('xls', 'xlsx', 'csv') then 'spreadsheet'
            when file_type in ('jpg', 'jpeg', 'png', 'gif', 'webp') then 'image'
            when file_type in ('mp4', 'avi', 'mov', 'mkv') then 'video' else 'unknown' end as category from v_typed""",
    "fil9_supported": "select job_id, path, file_type from v_typed where file_type <> 'unknown'",
    "fil10_empty_files": """
        select job_id, member_path, 'Empty file: ' || path as error from v_paths
        where path is not null and not ends_with(member_path, '/') and member_size = 0""",
    "fil11_summary": """
        select job_id, count(*) filter (category = 'document') as document_count,
            count(*) filter (category = 'spreadsheet') as spreadsheet_count,
            count(*) filter (category = 'image') as image_count, count(*) filter (category = 'video') as video_count,
            count(*) filter (category = 'unknown') as unknown_count, count(*) as total_files,
            sum(file_size)::bigint as total_bytes, round(sum(file_size) / 1048576.0::double, 2) as total_mb
        from v_files group by 1""",
    "fil12_directory_nodes": """
        select job_id, node as path, case when depth > 0 then array_to_string(parts[1:depth - 1], '/') end as parent_path,
            case when depth > 0 then parts[depth] else 'root' end as name, depth::bigint as depth, bool_and(depth = len(parts)) as is_file
        from (select job_id, parts, depth, array_to_string(parts[1:depth], '/') as node
              from (select job_id, string_split(path, '/') as parts,
                    unnest(range(0, len(string_split(path, '/')) + 1)) as depth from v_files))
        group by 1, 2, 3, 4, 5""",
    "fil13_file_ids": "select job_id, path, file_id from v_files",
    # documents
    "prj1_parseable": "select job_id, path, file_type from v_files where file_type in ('pdf', 'doc', 'docx')",
    "prj2_non_blank_pages": f"select doc_id, page_number from v_pages where trim(text, {BLANKS}) <> ''",
    "prj3_service_candidates": f"""
        select doc_id, {base_name('min(source_file)')} as doc_name, max(length(trim(f.text, {BLANKS})))::bigint as chars
        from v_pages p join v_full f using (doc_id) group by doc_id
        having (ends_with({base_name('min(source_file)')}, '.pdf') or ends_with({base_name('min(source_file)')}, '.docx'))
            and max(length(trim(f.text, {BLANKS}))) >= 100""",
    "prj4_corpus_stats": """
        select count(distinct doc_id) as documents, count(*) as pages, sum(len(tables))::bigint as tables,
            sum(n_images)::bigint as images from v_table_pages""",
    "prj5_base_names": f"select doc_id, page_number, {base_name('source_file')} as file_name from v_pages",
    "prj6_images_by_category": """
        select category, count(*) as images, nullif(count(*) filter (is_product), 0) as product_images
        from v_analyses group by 1""",
    "prj7_pricing_tables": """
        select table_id, table_type, array_to_string(cells[1], '|') as headers from v_tables where table_type = 'pricing'""",
    "dat1_pdf_dates": """
        select o_orderkey, case when o_orderkey % 4 = 0 then null else
            strftime(o_orderdate::date, '%Y-%m-%d') || ' 11:22:33' end as created from orders""",
    # tables
    "tab1_raw_tables": f"select table_id, table_index, {rows_text('raw')} as raw from v_raw",
    "tab2_clean_tables": f"select table_id, {rows_text('cells')} as cells from v_clean",
    "tab3_valid_tables": f"select table_id, {VALID} as valid from v_clean",
    "tab4_plausible_tables": """
        select table_id, len(raw) >= 2 and
            len(list_filter(flatten(raw), lambda c: trim(coalesce(c, '')) <> '')) >= 1 as plausible from v_raw""",
    "tab5_even_width": "select table_id, len(list_distinct(list_transform(cells, lambda r: len(r)))) <= 2 as even from v_clean",
    "tab6_pricing": table_test(PRICING),
    "tab7_itinerary": table_test(ITINERARY),
    "tab8_specifications": table_test(header_test("specifications")),
    "tab9_menu": table_test(header_test("menu")),
    "tab10_inventory": table_test(header_test("inventory")),
    "tab11_classify": "select table_id, table_type from v_tables",
    "tab12_structure": f"""
        select table_id, source_file as source_doc, page_number as source_page, array_to_string(cells[1], '|') as headers,
            {rows_text('cells[2:]')} as rows, substring(text, 1, 500) as context from v_tables""",
    "tab13_confidence": """
        select table_id, least(0.5::double + case when len(cells) > 2 and len(cells[1]) > 1 then 0.2::double else 0 end
            + case when table_type <> 'general' then 0.2::double else 0 end, 1) as confidence from v_tables""",
    "tab14_count_by_type": "select table_type, count(*) as tables from v_tables group by 1",
    "tab15_shape": "select table_id, len(cells)::bigint as row_count, len(cells[1])::bigint as column_count from v_tables",
    # keywords
    "kw1_tokens": f"select doc_id, page_number, {sorted_text(f'list_distinct({tokens("text")})')} as tokens from v_pages",
    "kw2_without_stopwords": f"""
        select token, count(*) as pages from (select unnest(list_distinct({tokens('text')})) as token from v_pages) group by 1""",
    "kw3_emails": f"""
        select doc_id, page_number, array_to_string({lowered(matches('text', fv.EMAIL_IN_TEXT))}, ' ') as emails from v_pages""",
    "kw4_phones": f"select doc_id, page_number, array_to_string({matches('text', fv.PHONE_IN_TEXT)}, ' ') as phones from v_pages",
    "kw5_urls": f"""
        select page_id, array_to_string({lowered(matches("url || ' ' || html", fv.URL_IN_TEXT))}, ' ') as urls from pages""",
    "kw6_prices": "select p_partkey, '$' || floor(p_retailprice)::bigint || '.50' as prices from part",
    "kw7_ngrams": f"""
        select doc_id, page_number, {ngrams('words', 2)} as bigrams, {ngrams('words', 3)} as trigrams
        from (select doc_id, page_number, {ORDERED} as words
            from (select doc_id, page_number, {tokens('text')} as all_words from v_pages))""",
    "kw8_keywords": f"select doc_id, page_number, {sorted_text(keywords('text'))} as keywords from v_pages",
    "kw9_capitalised": r"""
        select doc_id, page_number, array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
            lambda w: regexp_full_match(w, '[A-Z][a-z]+')), ' ') as names from v_pages""",
    # index
    "idx1_page_postings": "select doc_id, page_number, keyword from v_keywords",
    "idx1_stored_postings": "select query_id, keyword, doc_id, page_number, relevance from v_found",
    "idx2_relevance": "select doc_id, page_number, keyword, relevance, position from v_postings",
    "idx3_snippets": "select doc_id, page_number, keyword, snippet from v_snippets",
    "idx4_posting_lists": """
        select keyword, segment, string_agg(doc_id || ':' || page_number, ' ' order by doc_id, page_number) as refs
        from (select *, case when n > 200 then ('0x' || substring(md5(doc_id || ':' || page_number), 1, 8))::bigint
                % ceil(n / 200)::bigint else 0 end::bigint as segment
              from (select *, count(*) over (partition by keyword) as n from v_keywords))
        group by 1, 2""",
    "idx5_document_nodes": f"""
        select doc_id, {base_name('min(source_file)')} as title, 1::bigint as start_page, count(*) as end_page,
            'Document with ' || count(*) || ' pages' as summary,
            arg_min(substring(coalesce(text, ''), 1, 500), page_number) as content_snippet, any_value(coalesce(k.n, 0)) as keywords
        from v_pages left join (select doc_id, count(distinct keyword) as n from v_keywords group by 1) k using (doc_id)
        group by 1""",
    "idx6_tree": f"""
        select doc_id as node_id, 'root' as parent_id, {base_name('min(source_file)')} as title, 1::bigint as depth
        from v_pages group by doc_id
        union all select 'root', null, 'Index containing ' || count(distinct doc_id) || ' documents', 0 from v_pages""",
    "idx7_table_postings": f"""
        select unnest(list_distinct(list_concat({keywords("array_to_string(cells[1], ' ')")},
            {keywords("array_to_string(flatten(cells[2:6]), ' ')")}))) as keyword, table_id, page_number as source_page, table_type,
            array_to_string(cells[1], '|') as headers, substring(text, 1, 200) as snippet from v_tables""",
    "idx8_media_postings": f"""
        select unnest({keywords('a.description')}) as keyword, i.image_id, i.file_path, coalesce(a.category, 'unknown') as category,
            i.source_doc, substring(coalesce(a.description, ''), 1, 200) as description
        from v_images i left join v_analyses a using (image_id)""",
    "idx9_index_stats": """
        select (select count(distinct doc_id) from v_pages) as total_documents,
            (select count(distinct doc_id) from v_pages) + 1 as total_tree_nodes,
            (select count(*) from v_tables) as total_tables, (select count(*) from embeddings) as total_images,
            (select count(distinct keyword) from v_keywords) as total_keywords""",
    "idx10_keyword_stats": """
        select (select count(distinct doc_id) from v_pages) as total_documents, (select count(*) from v_pages) as total_pages,
            round((select count(*) from v_keywords)::double / (select count(*) from v_pages), 6) as avg_keywords_per_page,
            (select count(distinct keyword) from v_keywords) as total_keywords""",
    "idx11_compress": """
        select keyword, rank, doc_id, page_number, relevance from (select *, row_number() over (partition by keyword
            order by relevance desc, doc_id, page_number) as rank from v_postings) where rank <= 10""",
    "idx12_keyword_frequency": """
        select keyword, count(*) as pages from v_keywords group by 1 order by pages desc, keyword limit 50""",
    # retrieval
    "ret1_query_terms": "select query_id, keyword, count(*) over (partition by query_id) as n_terms from v_base_terms",
    "ret2_synonyms": "select query_id, keyword, n_terms from v_terms",
    "ret3_term_postings": "select query_id, keyword, doc_id, page_number, relevance from v_found",
    "ret4_page_scores": "select query_id, doc_id, page_number, score, best_keyword from v_matched",
    "ret5_ranking": "select query_id, doc_id, page_number, rank from v_ranked",
    "ret6_topk_pages": "select query_id, rank, doc_id, page_number, score from v_top",
    "ret7_context": f"""
        select query_id, {CONTEXT.format(name=base_name('source_file'), body='snippet')} as context
        from v_top t join v_snippets s on t.doc_id = s.doc_id and t.page_number = s.page_number and t.best_keyword = s.keyword
        join v_pages p on p.doc_id = t.doc_id and p.page_number = t.page_number group by 1""".replace(
        "page_number || ']'", "t.page_number || ']'"
    ),
    "ret8_confidence": """
        select query_id, coalesce(round(least(avg(score) + least(count(score) * 0.1::double, 0.3::double), 1), 6), 0) as confidence
        from v_questions left join v_top using (query_id) group by 1""",
    "ret9_match_counts": """
        select query_id, count(score) as matched_pages from v_questions left join v_matched using (query_id) group by 1""",
    "ret10_keyword_lookup": """
        select keyword, total_hits, ref, doc_id, page_number, substring(snippet, 1, 200) as snippet
        from (select keyword, doc_id, page_number, count(*) over (partition by keyword) as total_hits,
            row_number() over (partition by keyword order by doc_id, page_number) as ref
            from v_postings where keyword in (select keyword from v_terms)) join v_snippets using (keyword, doc_id, page_number)
        where ref <= 5""",
    "ret11_signal_ranking": """
        select query_id, rank, doc_id, page_number, signal_score from (select *, row_number() over (partition by query_id
            order by signal_score desc, doc_id, page_number) as rank from (
            select query_id, m.doc_id, m.page_number, round(score * 0.5::double + (terms_found / n_terms) * 0.3::double
                + least(length(snippet) / 200, 1) * 0.2::double, 6) as signal_score
            from v_matched m join v_snippets s on m.doc_id = s.doc_id and m.page_number = s.page_number
                and m.best_keyword = s.keyword)) where rank <= 5""",
    "ret12_page_context": f"""
        select query_id, {CONTEXT.format(name='source_file', body="substring(coalesce(text, ''), 1, 1000)")} as context
        from v_top t join v_pages p using (doc_id, page_number) group by 1""",
    "retrieve_answers": f"""
        select q.query_id, q.query, coalesce(m.n, 0) as matched_pages, coalesce(m.best, 0) as best_score,
            coalesce(t.ranked, '') as ranked, coalesce(t.confidence, 0) as confidence, coalesce(t.context, '') as context
        from v_questions q
        left join (select query_id, count(*) as n, max(score) as best from v_matched group by 1) m using (query_id)
        left join (select query_id, string_agg(t.doc_id || ':' || t.page_number, ' ' order by rank) as ranked,
            round(least(avg(score) + least(count(*) * 0.1::double, 0.3::double), 1), 6) as confidence,
            {CONTEXT.format(name=base_name('s.source_file'), body='s.snippet').replace("page_number ||", "t.page_number ||")} as context
            from v_top t join (select v_snippets.*, source_file from v_snippets join v_pages using (doc_id, page_number)) s
              on t.doc_id = s.doc_id and t.page_number = s.page_number and t.best_keyword = s.keyword group by 1) t using (query_id)""",
    # images
    "med1_content_hash": "select image_id, md5(content) as hash from v_images",
    "med2_drop_duplicates": """
        select image_id, job_id, md5(content) as image_hash from (select *, row_number() over
            (partition by job_id, content order by seq) as n from v_images) where n = 1""",
    "med3_near_pairs": "select job_id, earlier, later from v_near",
    "med3_drop_near_duplicates": """
        select job_id, 'img_' || seq as image_id from (
            with recursive ordered as (select job_id, seq, bits, row_number() over (partition by job_id order by seq) as i from v_images),
            pass as (
                select job_id, seq, i, true as keep, [bits] as kept from ordered where i = 1
                union all
                select o.job_id, o.seq, o.i, coalesce(len(list_filter(p.kept, lambda k: bit_count(xor(k, o.bits)) < 5)), 0) = 0,
                    case when len(list_filter(p.kept, lambda k: bit_count(xor(k, o.bits)) < 5)) = 0
                        then list_append(p.kept, o.bits) else p.kept end
                from pass p join ordered o on o.job_id = p.job_id and o.i = p.i + 1)
            select * from pass where keep)""",
    "med4_quality": """
        select image_id, resolution, gap < 0.1 as standard_ratio,
            case when gap < 0.1 then least(base + 0.1::double, 1) else base end as quality_score from v_quality""",
    "med5_alternative_quality": """
        select image_id, case when width * height >= 2073600 then 1.0 when width * height >= 921600 then 0.8
                when width * height >= 307200 then 0.6 else 0.4 end::double as resolution_score,
            case when gap < 0.1 then 1.0 when gap < 0.2 then 0.8 else 0.6 end::double as ratio_score from v_quality""",
    "med6_summary": """
        select job_id, count(*) filter (is_embedded) as embedded_count, count(*) filter (not is_embedded) as standalone_count,
            sum(file_size)::bigint as total_size_bytes, count(*) - count(distinct content) as duplicates_removed
        from v_images group by 1""",
    "med7_format": f"""
        select image_id, coalesce({case_of(fv.IMAGE_FORMATS, f"ltrim({suffix('file_path')}, '.')")}, 'jpg') as format,
            coalesce({case_of(fv.IMAGE_FORMATS, f"ltrim({suffix('file_path')}, '.')")}, 'unknown') as known_format from v_images""",
    "med8_all_images": "select image_id, case when is_embedded then 0 else 1 end::bigint as part, seq from v_images",
    "med9_with_analysis": "select image_id, file_path, description from v_images join v_analyses using (image_id)",
    "med10_associations": """
        select job_id, item_id, image_id from v_overlap where is_product and (named or overlap > 0.5 or same_page)""",
    "med11_tag_overlap": """
        select item_id, round(overlap, 6) as overlap from v_overlap where image_id = 'img_' || item_id""",
    "med12_unassociated": """
        select job_id, image_id from v_analyses where (job_id, image_id) not in (select (job_id, image_id) from v_overlap
            where (is_product or is_service_related) and (named or overlap > 0.5 or same_page))""",
    # request and answer tables
    "llm1_full_text": "select doc_id, 0::bigint as part, text from v_full",
    "llm2_business_type": f"""
        select job_id, case when regexp_matches(sample, '{"|".join(fv.SERVICE_WORDS)}') then 'service'
            when regexp_matches(sample, '{"|".join(fv.PRODUCT_WORDS)}') then 'product' else 'service' end as business_type
        from (select job_id, lower(string_agg(coalesce(substring(text, 1, 1000), ''), '' order by doc_order)) as sample
            from (select *, row_number() over (partition by job_id order by doc_order) as n from v_docs) left join v_full using (doc_id)
            where n <= 2 group by 1)""",
    "llm3_company_requests": """
        select job_id, substring(string_agg(coalesce(substring(text, 1, 2000), ''), '' order by doc_order), 1, 4000) as input
        from (select *, row_number() over (partition by job_id order by doc_order) as n from v_docs) left join v_full using (doc_id)
        where n <= 3 group by 1""",
    "llm4_service_requests": f"""
        select doc_id, {base_name('min(source_file)')} as doc_name, substring(any_value(f.text), 1, 7000) as input
        from v_pages p join v_full f using (doc_id) group by doc_id
        having regexp_matches({base_name('min(source_file)')}, '\\.(pdf|docx)$') and max(length(trim(f.text, {BLANKS}))) >= 100""",
    "llm5_image_prompts": """
        select image_id, case when coalesce(text, '') <> '' then 'Context from source document:' || chr(10)
            || substring(text, 1, 500) || chr(10) || chr(10) else '' end || 'Describe the image.'
            || case extraction_method when 'embedded_pdf' then chr(10) || chr(10) || 'Note: This image was embedded in a business document.'
               when 'embedded_docx' then chr(10) || chr(10) || 'Note: This image was embedded in a Word document.' else '' end as prompt
        from v_images i left join v_pages p on p.doc_id = i.source_doc and p.page_number = i.source_page""",
    "llm6_fenced_answers": """
        select doc_id, data->>'$.description' as description, data->>'$.policies.cancellation' as cancellation,
            (data->>'$.price')::double as price from v_fenced""",
    "llm7_braced_answers": """
        select image_id, case when j is null then substring(response, 1, 500) else j->>'$.description' end as description,
            case when j is null then 'other' else j->>'$.category' end as category,
            case when j is null then '' else array_to_string((j->'$.tags')::varchar[], ' ') end as tags,
            case when j is null then false else (j->>'$.is_product')::boolean end as is_product,
            case when j is null then 0.5 else (j->>'$.confidence')::double end as confidence
        from v_braced""",
    "llm8_categories": f"""
        select p_partkey, case when p_partkey % 2 = 0 then (['product', 'food', 'logo', 'other'])[p_partkey % 4 + 1]
            when string_split(p_name, ' ')[1] in ({listed(fv.IMAGE_CATEGORIES)}) then string_split(p_name, ' ')[1]
            else 'other' end as category from part""",
    "llm9_analyses": f"""
        select r.image_id, case when r.error is not null or response is null then 'Vision analysis unavailable: '
                || coalesce(r.error, 'no response')
            when j is null then substring(response, 1, 500) else j->>'$.description' end as description,
            case when trim(lower(j->>'$.category')) in ({listed(fv.IMAGE_CATEGORIES)}) then trim(lower(j->>'$.category'))
                else 'other' end as category,
            case when r.error is not null or response is null then 0 when j is null then 0.5
                else (j->>'$.confidence')::double end as confidence
        from v_responses r left join (select image_id, j from v_braced where error is null) using (image_id)""",
    "llm10_services": f"""
        select doc_id, 'svc_' || lower(replace(substring(doc_name, 1, 20), ' ', '_')) as service_id,
            replace(replace(doc_name, '.pdf', ''), '.docx', '') as name,
            coalesce(nullif(data->>'$.description', ''), 'Business offering - ' || doc_name) as description,
            coalesce(nullif(data->>'$.category', ''), 'General') as category, nullif((data->>'$.price')::double, 0) as base_price,
            case when {nonzero("(data->>'$.price')::double")} then 'INR' end as currency,
            data->>'$.policies.cancellation' as cancellation_policy, lower(coalesce(data->>'$.category', 'business')) as tags,
            coalesce(array_to_string(data->>'$.inclusions[*]', ' '), '') as inclusions,
            coalesce(array_to_string(data->>'$.exclusions[*]', ' '), '') as exclusions,
            coalesce('seats=' || (data->>'$.details.seats') || ' size=' || (data->>'$.details.size'), '') as details,
            coalesce((data->>'$.faqs[0].question') || '?' || (data->>'$.faqs[0].answer'), '') as faqs
        from v_fenced""",
    "llm3_company_info": """
        select doc_id, data->>'$.name' as name, data->>'$.description' as description, data->>'$.category' as category,
            data->>'$.email' as email, data->>'$.phone' as phone, data->>'$.website' as website from v_fenced""",
    "llm11_named_services": "select profile_id, service_id, name from v_services where coalesce(name, '') <> ''",
    "llm12_assembled_profiles": """
        select profile_id, job_id, business_type, p.name as business_name, 0::bigint as part, coalesce(services, '') as services,
            coalesce(documents, 0) as source_files_count, coalesce(documents, 0) + 2 as llm_calls
        from v_profiles p left join (select job_id, count(*) as documents from v_docs group by 1) using (job_id)
        left join (select profile_id, string_agg(service_id, ' ' order by ordinal) as services from v_services group by 1)
            using (profile_id)""",
    "llm12_whole_profiles": f"""
        select 'profile_' || job_id as profile_id, job_id, business_type, c.data->>'$.name' as name,
            c.data->>'$.description' as description, c.data->>'$.category' as category, c.data->>'$.email' as email,
            coalesce(part, 0) as part, coalesce(services, '') as services, '2024-05-01' as extraction_date,
            documents as source_files_count, documents + 2 as llm_calls_made, 0.8::double as confidence_score,
            'groq_llm' as extraction_method, '2.0' as version
        from (select job_id, count(*) as documents from v_docs group by 1)
        left join ({{types}}) using (job_id)
        left join (select 'job_' || doc_id as job_id, data from v_fenced) c using (job_id)
        left join (
            select job_id, n // 4 as part, string_agg(concat_ws(':', n, service_id, category, price, cancellation), ' ' order by n) as services
            from (select d.job_id, row_number() over (partition by d.job_id order by doc_order) - 1 as n,
                'svc_' || lower(replace(substring(doc_name, 1, 20), ' ', '_')) as service_id,
                coalesce(nullif(data->>'$.category', ''), 'General') as category,
                nullif((data->>'$.price')::bigint, 0) as price, data->>'$.policies.cancellation' as cancellation
                from v_fenced f join v_docs d on d.doc_id = 'd' || f.doc_id)
            group by all) using (job_id)""",
    # validation
    "val1_emails": f"select profile_id, email, regexp_matches(email, {quoted(fv.EMAIL_ADDRESS)}) as valid from v_profiles",
    "val2_phones": r"select profile_id, phone, length(regexp_replace(phone, '\D', '', 'g')) >= 7 as valid from v_profiles",
    "val3_urls": f"select profile_id, website, regexp_matches(website, {quoted(fv.WEB_ADDRESS)}) as valid from v_profiles",
    "val4_contact": f"select profile_id, {FINDING} from v_own_findings where f.field like 'business_info.contact%'",
    "val5_info": f"""
        select profile_id, {FINDING} from v_own_findings
        where f.field in ('business_info', 'business_info.name', 'business_info.description')""",
    "val6_location": f"select profile_id, {FINDING} from v_own_findings where f.field = 'business_info.location'",
    "val7_hours": f"select profile_id, {FINDING} from v_own_findings where f.field = 'business_info.working_hours'",
    "val8_products": "select * from v_name_findings where field like 'products%'",
    "val9_services": "select * from v_name_findings where field like 'services%'",
    "val10_prices": "select * from v_price_findings",
    "val11_missing_items": "select * from v_missing_items",
    "val12_info_score": "select profile_id, round(business_info, 9) as score from v_scores",
    "val13_product_score": f"""
        select profile_id, round(avg(0::double + case when {filled('name')} then 0.3::double else 0 end
            + case when {filled('description')} then 0.2::double else 0 end + case when {nonzero('base_price')} then 0.3::double else 0 end
            + case when has_specifications then 0.2::double else 0 end), 9) as score from v_products group by 1""",
    "val14_service_score": f"""
        select profile_id, round(avg(0::double + case when {filled('name')} then 0.25 else 0 end
            + case when {filled('description')} then 0.25 else 0 end + case when {nonzero('base_price')} then 0.25 else 0 end
            + case when details_kind = 0 or {has('itinerary')} then 0.25 else 0 end), 9) as score from v_services group by 1""",
    "val15_completeness": "select profile_id, completeness from v_complete",
    "val16_field_scores": """
        select profile_id, s.g as field_group, round(s.v, 9) as score from (select profile_id, unnest([
            {'g': 'business_info', 'v': business_info}, {'g': 'products', 'v': products}, {'g': 'services', 'v': services}]) as s
            from v_scores)""",
    "val17_validity": "select profile_id, errors, warnings, is_valid from v_valid",
    "val18_missing_profiles": """
        select job_id, 'profile' as field, 'missing' as error_type, 'No profile to validate' as message, 'error' as severity
        from v_jobs where job_id not in (select job_id from v_profiles)""",
    "validate_profiles": """
        select job_id, v.profile_id, coalesce(is_valid, false) as is_valid, coalesce(errors, 1) as errors,
            coalesce(warnings, 0) as warnings, coalesce(completeness, 0) as completeness
        from v_jobs left join v_valid v using (job_id) left join v_complete c using (job_id)""",
    "val19_editor_completeness": f"""
        select profile_id, round(business_info, 9) as business_info, round(services, 9) as services,
            round(business_info * 0.3::double + services * 0.7::double, 9) as overall from (
            select profile_id, (({filled('p.name')})::int + ({filled('p.description')})::int + ({filled('p.category')})::int
                + ({filled('phone')})::int + ({filled('email')})::int + ({filled('website')})::int)::double / 6 as business_info,
                coalesce(score, 0) as services
            from v_profiles p left join (select profile_id, avg(({EDITOR13})::double / 13) as score
                from v_services group by 1) using (profile_id))""",
    "val19_service_scores": f"select profile_id, ordinal, round(({EDITOR13})::double / 13, 9) as score from v_services",
    "val20_service_fill": f"""
        select profile_id, ordinal, ({FILLED13})::bigint as filled, floor(({FILLED13})::double / 13 * 100)::bigint as percent
        from v_services""",
    "val21_out_of_range": """
        select member_path as row_key, 'member_size' as column_name, member_size::double as value from v_members where member_size <= 0
        union all select service_id, 'base_price', base_price from v_services where base_price < 0
        union all select service_id, 'discount_price', discount_price from v_services where discount_price < 0
        union all select doc_id, 'page_number', page_number from v_pages where page_number < 1""",
    "val21_all_ranges": """
        select * replace (round(value, 9) as value) from (
            select 'file' as record, member_path as row_key, 'file_size' as column_name, member_size::double as value
            from v_members where member_size <= 0
            union all select 'page', doc_id, 'page_number', page_number from v_pages where page_number < 1
            union all select 'pricing', service_id, 'base_price', base_price from v_services where base_price < 0
            union all select 'pricing', service_id, 'discount_price', discount_price from v_services where discount_price < 0
            union all select 'business', s_suppkey::varchar, 'average_rating', s_acctbal::double / 1500 from supplier
            union all select 'extraction', c_custkey::varchar, 'confidence_score', c_acctbal::double / 8000 from customer
            union all select 'scores', o_orderkey::varchar, 'completeness_score', o_totalprice::double / 100000 from orders
            union all select 'job', l_orderkey::varchar, 'progress', l_extendedprice::double / 900 from lineitem)
        where column_name not in ('average_rating', 'confidence_score', 'completeness_score', 'progress') or value < 0
            or value > case column_name when 'average_rating' then 5 when 'progress' then 100 else 1 end""",
    "val22_exclusive_items": """
        select profile_id, 'products' as field, 'Service-only business cannot have products' as message from v_profiles
            where business_type = 'service' and profile_id in (select profile_id from v_products)
        union all select profile_id, 'services', 'Product-only business cannot have services' from v_profiles
            where business_type = 'product' and profile_id in (select profile_id from v_services)""",
    "val23_field_score_rows": f"""
        select profile_id, g.n as field_group, g.t::bigint as total_fields, g.p::bigint as populated_fields,
            round(g.p::double / g.t, 6) as score
        from (select profile_id, unnest([
            {{'n': 'business_info', 't': 3, 'p': {filled('name')}::int + {filled('description')}::int + {filled('category')}::int}},
            {{'n': 'location', 't': 4, 'p': {filled('address')}::int + {filled('city')}::int + {filled('country')}::int}},
            {{'n': 'contact', 't': 3, 'p': {filled('phone')}::int + {filled('email')}::int + {filled('website')}::int}}]) as g
            from v_profiles)""",
    # profile store
    "pro1_upsert": """
        select coalesce(u.job_id, b.job_id) as job_id,
            case when u.job_id like '%3' then u.business_name || ' again'
                when u.job_id is not null then u.business_name else b.business_name end as business_name,
            case when u.job_id like '%3' then 'AGAIN' when u.job_id is not null then u.category else b.category end as category,
            coalesce(b.version, 0) + (u.job_id is not null)::bigint + coalesce(u.job_id like '%3', false)::bigint as version,
            case when u.job_id is not null then '2024-02-01' else b.saved_at end as saved_at
        from v_store b full join v_edits u on b.job_id = u.job_id""",
    "pro2_delete": "select job_id, business_name from v_store where job_id not in (select job_id from v_edits)",
    "pro3_replace_services": """
        select b.profile_id, b.ordinal, case when s_suppkey is null then service_id else 'svc_new' end as service_id,
            case when s_suppkey is null then name else s_name end as name,
            case when s_suppkey is null then category else 'changed' end as category
        from v_dense b left join supplier on s_suppkey = b.profile_id and s_nationkey = b.ordinal""",
    "pro4_append_services": """
        select profile_id, ordinal, service_id, name, category from v_dense
        union all
        select profile_id, ordinal, 'svc_' || ordinal, name, 'part' from (
            select p_size::bigint as profile_id, p_name as name, coalesce(n, 0) - 1
                + row_number() over (partition by p_size order by p_partkey) as ordinal
            from part left join (select profile_id, count(*) as n from v_dense group by 1) c on c.profile_id = p_size)""",
    "pro5_delete_services": """
        select profile_id, n as ordinal, 'svc_' || n as service_id, name, category from (select *,
            row_number() over (partition by profile_id order by ordinal) - 1 as n from v_dense where category <> 'F')""",
    "pro6_list": """
        select job_id, coalesce(name, 'Unknown') as business_name, business_type, coalesce(s.n, 0) as services_count,
            coalesce(q.n, 0) as products_count, saved_at
        from v_profiles left join (select profile_id, count(*) as n from v_services group by 1) s using (profile_id)
        left join (select profile_id, count(*) as n from v_products group by 1) q using (profile_id)""",
    "pro7_all_items": """
        select profile_id, 'service' as item_kind, ordinal, name, base_price, service_id, null as product_id from v_services
        union all select profile_id, 'product', ordinal, name, base_price, null, product_id from v_products""",
    "pro8_flatten": """
        select profile_id, ordinal, kv.key as key, case when kv.key = 'grade' and details_kind = 0 then 'easy' else kv.value end as value
        from v_item_maps join v_services using (profile_id, ordinal)
        where kv.value is not null or (kv.key = 'grade' and details_kind = 0)
        union all select profile_id, ordinal, 'duration', (ordinal % 14) || ' days' from v_services where details_kind = 0""",
    "pro9_humanize": r"""
        select p_partkey, key, array_to_string(list_transform(string_split(regexp_replace(translate(key, '_-', '  '),
            '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') as label
        from (select p_partkey, replace(p_name, ' ', '_') || '-' || lower(substring(p_type, 1, 3))
            || upper(substring(p_type, 1, 1)) || lower(substring(p_type, 2)) as key from part)""",
    "pro10_badges": """
        select profile_id, ordinal, b.f as field, b.l || ' (' || b.n || ')' as label, b.n::bigint as entries
        from (select profile_id, ordinal, unnest([{'f': 'itinerary', 'l': 'Itinerary', 'n': len(itinerary)},
            {'f': 'inclusions', 'l': 'Inclusions', 'n': len(inclusions)}, {'f': 'exclusions', 'l': 'Exclusions', 'n': len(exclusions)},
            {'f': 'faqs', 'l': 'FAQ', 'n': len(faqs)}, {'f': 'tags', 'l': 'Tags', 'n': len(tags)}]) as b from v_services)
        where b.n > 0""",
    "pro11_policies": """
        select profile_id, ordinal, kv.key as key, kv.value as value from v_item_maps
        where regexp_matches(kv.key, 'policy|warranty|refund|terms') and coalesce(kv.value, '') <> ''""",
    "pro12_price_labels": r"""
        select profile_id, ordinal, case when coalesce(base_price, 0) <> 0 then coalesce(currency, '₹')
            || regexp_replace(regexp_replace(format('{:,.3f}', round(base_price, 3)), '0+$', ''), '\.$', '') end as label
        from v_services""",
    "pro13_first_key": """
        select profile_id, ordinal, case when details_kind = 0 then 'grade' end as key from v_services""",
    "pro14_migrate": """
        select job_id, case when version <> 2 and category <> 'BUILDING' then lower(category) else category end as category,
            case when version = 2 or category <> 'BUILDING' then '1.1' else '0.9' end as schema_version,
            case when version <> 2 and category <> 'BUILDING' then 'per unit' end as price_type,
            case when version <> 2 and category = 'BUILDING' then 'No migration path from 0.9 to 1.1' end as error
        from v_store""",
    # jobs
    "job1_latest_status": "select job_id, status, phase, progress, error from v_status",
    "job1_status_stream": "select job_id, status, phase, progress, error from v_status",
    "job2_progress": """
        select event_id, phase, case phase when 'file_discovery' then 10.0 when 'document_parsing' then 30.0
            when 'schema_mapping' then 95.0 when 'done' then 100.0 end::double as progress from v_events""",
    "job3_count_by_status": "select status, count(*) as jobs from v_status group by 1",
    "job4_phase_durations": "select job_id, event_id, phase, round(seconds, 3) as seconds from v_durations",
    "job4_phase_totals": """
        select phase, count(*) as events, round(sum(seconds), 3) as total_seconds from v_durations group by 1""",
    "job5_outcome_rates": """
        select count(*) as jobs, round(avg((status = 'completed')::int), 6) as success_rate,
            round(avg((status = 'failed')::int), 6) as failure_rate from v_status""",
    "job6_ingest_stream": "select doc_id, page_number, keyword, relevance from v_postings where doc_id like 'd%'",
    "job6_stream_lookup": """
        select query_id, keyword, doc_id, page_number, relevance from v_found where doc_id like 'd%'""",
}

_SQL["llm12_whole_profiles"] = _SQL["llm12_whole_profiles"].format(types=_SQL["llm2_business_type"])
for _stored, _plain in (
    ("pro1_stored_upsert", "pro1_upsert"), ("pro2_stored_delete", "pro2_delete"), ("pro3_stored_replace", "pro3_replace_services"),
    ("pro4_stored_append", "pro4_append_services"), ("pro5_stored_delete", "pro5_delete_services"),
):
    _SQL[_stored] = _SQL[_plain]
_SQL["retrieve_stored_answers"] = _SQL["retrieve_answers"]

ORACLES = {name: with_views(sql) for name, sql in _SQL.items()}
