"""Schemas of the records, always given to the readers: inferred ones would mix whole and fractional numbers."""

FOOTPRINT = "building_id string, area_pixels double, polygon array<array<double>>"
GENERATED = FOOTPRINT + ", source_folder string, source_image_count int, x int, z int, w int, d int, h double, floors int, type string, hasBasement boolean, detection_status string, geometry_status string"
PARCEL = "parcel_id string, owner_reference string, polygon array<array<double>>"
VALIDATION = "building_id string, validation_status string, parcel_id string, overlap_iou double, building_coverage double"
FLOOR = "struct<floor_number:int,floor_label:string,estimated_floor_area:double,estimated_flat_count:int,flats:array<string>,data_source:string,floor_id:string,`3d_property_ids`:array<string>>"
SCENE = (
    "id int, building_id string, x double, z double, w double, d double, h double, floors int, type string, hasBasement boolean, ulpin string, area_pixels double, polygon array<array<double>>, "
    "validation struct<status:string,parcel_id:string,overlap_iou:double,building_coverage:double>, "
    f"apartments struct<total_estimated_flats:int,estimated_flats_per_floor:int,status:string,data_source:string,floors:array<{FLOOR}>>"
)
PROPERTY = (
    "building_id string, geometry struct<coordinate_system:string,polygon:array<array<double>>>, "
    "measurements struct<area_pixels:double,height_meters:double,estimated_floors:int,estimated_total_flats:int,estimated_flats_per_floor:int>, "
    f"apartments struct<total_estimated_flats:int,estimated_flats_per_floor:int,average_apartment_area_assumption:double,data_source:string,status:string,floors:array<{FLOOR}>>, "
    "data_sources struct<building_detection:string,height:string,floor_count:string>, "
    "validation struct<status:string,parcel_id:string,overlap_iou:double,building_coverage:double>, ulpin string, "
    "official_ulpin string, ulpin_status string, building_property_id string, identifier_status string"
)
MATCH = "image_a string, image_b string, keypoints_a int, good_matches int"
DESCRIPTOR = "image string, kp_idx int, descriptor array<float>"
PIXEL = "image_id string, y int, x int, value int"
ELEVATION = "building_id string, sample_idx int, dsm double, dem double"
