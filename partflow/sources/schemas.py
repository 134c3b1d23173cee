"""Declared schemas (DDL) of the stock tables; nothing is inferred."""

from __future__ import annotations

PARTS = "id long, part_number string, part_number_raw string, brand string, description string, quantity int, listed_quantity int, ebay_listing_id string, appliance_id long, created_at timestamp, updated_at timestamp"
APPLIANCES = "id long, brand string, model_number string, serial_number string, appliance_type string, notes string, photo_key string, status string, created_at timestamp, updated_at timestamp"
CROSS_REFERENCES = "part_id long, cross_ref_part_number string, relationship string, source_url string"
INVENTORY_EVENTS = "id long, part_id long, event_type string, quantity_change int, note string, created_at timestamp"
PROCESSED_LINES = "order_id string, line_id string, part_id long, quantity_depleted int, quarantine_reason string, processed_at timestamp"
VENDOR_TEMPLATES = "id long, vendor_key string, vendor_name string, vendor_domains array<string>, vendor_keywords array<string>, extraction_rules string, success_count int, fail_count int, last_generation_attempt timestamp"
VENDOR_PRESETS = "id long, vendor_key string, input_type string, page_fingerprint string, selectors string, sample_snippet string, success_count int, fail_count int, last_used_at timestamp"
VENDOR_DOMAINS = "id long, vendor_name string, domain string, auth_cookie_expiry timestamp, is_preset boolean, status string, last_tested_at timestamp"
SOLD_ORDERS = "orderId string, creationDate timestamp, lineItems array<struct<lineItemId:string,legacyItemId:string,quantity:int>>"
ITEM = "part_number string, part_name string, quantity double, unit_price double, ship_cost double, tax_price double, brand string"
RESPONSE = "vendor string, orderNumber string, orderDate string, technicianName string, trackingNumber string, deliveryCourier string, totalTax double, totalShipping double, items array<struct<partNumber:string,partName:string,quantity:double,unitPrice:double,brand:string>>"
RULES = "vendorName string, vendorSignals struct<domains:array<string>,keywords:array<string>>, lineItems struct<start:string,`end`:string,`row`:string>"
SEARCH_RESPONSE = "web struct<results:array<struct<title:string,description:string,url:string>>>"
OCR_RESPONSE = "md_results string, content string, text string, layout_details array<array<struct<content:string,label:string>>>"

STOCK_TABLES = {"parts": PARTS, "appliances": APPLIANCES, "cross_references": CROSS_REFERENCES, "inventory_events": INVENTORY_EVENTS, "processed_lines": PROCESSED_LINES, "vendor_templates": VENDOR_TEMPLATES, "vendor_presets": VENDOR_PRESETS, "vendor_domains": VENDOR_DOMAINS}
