"""Declared schemas of stored tables and JSON inputs."""

from __future__ import annotations

# Schemas are DDL text, so that this module loads without a running session.
TABLES: dict[str, str] = {
    "apartments": (
        "id long, external_id string, title string, address string, city string, state string, zipcode string, property_type string, "
        "latitude double, longitude double, pets_allowed boolean, has_parking boolean, has_pool boolean, has_gym boolean, "
        "has_dishwasher boolean, has_washer_dryer boolean, has_air_conditioning boolean, current_special string, is_available boolean, "
        "source_url string, data_source_type string, last_content_hash string, last_scraped_at timestamp, updated_at timestamp"
    ),
    "plans": (
        "id long, apartment_id long, name string, bedrooms double, bathrooms double, area_sqft double, price double, current_price double, "
        "max_price double, available_from timestamp_ntz, is_available boolean, external_url string, floor_level int, facing string"
    ),
    "units": (
        "id long, plan_id long, unit_number string, price double, area_sqft double, floor_level int, facing string, "
        "available_from timestamp_ntz, is_available boolean, last_scraped_at timestamp"
    ),
    "price_history": "plan_id long, price double, recorded_at timestamp",
    "subscriptions": (
        "id long, user_id long, unit_id long, plan_id long, apartment_id long, city string, zipcode string, min_bedrooms double, "
        "max_bedrooms double, target_price double, price_drop_pct double, baseline_price double, baseline_recorded_at timestamp, "
        "notify_email boolean, notify_telegram boolean, telegram_chat_id string, is_active boolean, last_notified_at timestamp, "
        "trigger_count int"
    ),
    "notifications": (
        "id long, subscription_id long, user_id long, sent_at timestamp, channel string, status string, external_id string, "
        "trigger_type string, trigger_price double, baseline_price double"
    ),
    "runs": (
        "id long, apartment_id long, run_at timestamp, url string, effective_url string, outcome string, path_cache_hit boolean, "
        "content_hash_short_circuit boolean, input_tokens long, output_tokens long, cost_usd double, elapsed_sec double, adapter_name string"
    ),
    "costs": (
        "ts timestamp, source string, name string, url string, outcome string, input_tok long, output_tok long, api_calls long, "
        "cache_hits long, cost_usd decimal(10,6)"
    ),
    "suppression": (
        "url string, first_failed_at timestamp, last_failed_at timestamp, last_reason string, attempt_count int, retry_after timestamp, notes string"
    ),
    "registry": (
        "domain string, robots_txt_allows boolean, is_active boolean, data_source_type string, corporate_parent_url string, "
        "corporate_platform string, last_successful_adapter string, last_adapter_success_at timestamp"
    ),
    "favourites": "user_id long, apartment_id long, created_at timestamp",
    "images": "id long, apartment_id long, url string, is_primary boolean, created_at timestamp",
    "neighborhoods": (
        "id long, name string, city string, state string, zipcode string, description string, walkability_score int, safety_score int, "
        "avg_price_per_sqft double"
    ),
    "pages": "page_id long, url string, html string",
}

PLACE = (
    "struct<external_id:string,place_resource_name:string,title:string,business_name:string,description:string,address:string,city:string,"
    "state:string,zipcode:string,latitude:double,longitude:double,property_type:string,source_url:string,phone:string,rating:double,"
    "user_rating_count:bigint>"
)
DISCOVERY = f"struct<total:bigint,city_counts:map<string,bigint>,apartments:array<{PLACE}>>"
SEED = "name string, url string, city string, state string, zip string"
STEP_CACHE = (
    "url string, domain string, steps array<struct<action:string,args:map<string,string>>>, apartment_name string, last_success string, "
    "success_count long"
)
WEBHOOK_EVENT = "struct<event:string,sg_message_id:string>"
PLACE_PAYLOAD = (
    "struct<name:string,id:string,displayName:struct<text:string>,formattedAddress:string,websiteUri:string,nationalPhoneNumber:string,"
    "rating:double,userRatingCount:bigint,location:struct<latitude:double,longitude:double>,types:array<string>>"
)
