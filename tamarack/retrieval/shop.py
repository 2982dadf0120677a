"""The schema that questions are asked over: its twelve tables, of which some are stored and others only named in statements."""

from __future__ import annotations

from tamarack.retrieval.schema import TableInfo


def _table(name: str, columns: str, foreign: dict[str, str] | None = None, comments: dict[str, str] | None = None) -> TableInfo:
    typed = dict(c.split(":") for c in columns.split())
    return TableInfo(name, typed, next(iter(typed)), foreign or {}, "", comments or {})


TABLES = [
    _table("categories", "category_id:integer category_name:text parent_category_id:integer description:text created_at:timestamp", {"parent_category_id": "categories"}, {"parent_category_id": "The category above, null at the top of the hierarchy."}),
    _table("suppliers", "supplier_id:integer supplier_name:text contact_name:text contact_email:text phone:text country:text city:text rating:decimal(3,2) is_active:boolean created_at:timestamp"),
    _table("warehouses", "warehouse_id:integer warehouse_name:text country:text city:text capacity_units:integer is_active:boolean created_at:timestamp"),
    _table("departments", "department_id:integer department_name:text location:text annual_budget:decimal(14,2) created_at:timestamp"),
    _table("employees", "employee_id:integer first_name:text last_name:text email:text phone:text hire_date:date job_title:text salary:decimal(12,2) department_id:integer manager_id:integer is_active:boolean created_at:timestamp", {"department_id": "departments", "manager_id": "employees"}, {"manager_id": "The manager, null at the top."}),
    _table("customers", "customer_id:integer customer_name:text email:text phone:text country:text city:text customer_segment:text credit_limit:decimal(12,2) signup_date:date is_active:boolean created_at:timestamp", None, {"customer_segment": "Individual or business.", "credit_limit": "Largest outstanding balance, null for individuals."}),
    _table("products", "product_id:integer product_name:text sku:text category_id:integer supplier_id:integer unit_price:decimal(12,2) unit_cost:decimal(12,2) weight_kg:decimal(10,3) is_discontinued:boolean created_at:timestamp", {"category_id": "categories", "supplier_id": "suppliers"}, {"unit_price": "List price now.", "unit_cost": "Cost of acquiring; revenue less cost is margin."}),
    _table("orders", "order_id:integer customer_id:integer employee_id:integer order_date:timestamp required_date:date status:text total_amount:decimal(12,2) shipping_cost:decimal(12,2) currency:text created_at:timestamp", {"customer_id": "customers", "employee_id": "employees"}, {"employee_id": "Sales representative, null for online self-service.", "total_amount": "Total with shipping."}),
    _table("order_items", "order_item_id:integer order_id:integer product_id:integer quantity:integer unit_price:decimal(12,2) discount_pct:decimal(5,2)", {"order_id": "orders", "product_id": "products"}, {"unit_price": "Price at the time of sale.", "discount_pct": "Percentage of discount; line revenue is after it."}),
    _table("payments", "payment_id:integer order_id:integer payment_date:timestamp amount:decimal(12,2) payment_method:text status:text transaction_ref:text", {"order_id": "orders"}),
    _table("shipments", "shipment_id:integer order_id:integer warehouse_id:integer shipped_date:timestamp delivered_date:timestamp carrier:text tracking_number:text status:text", {"order_id": "orders", "warehouse_id": "warehouses"}, {"delivered_date": "When it reached the customer, null before."}),
    _table("inventory", "inventory_id:integer product_id:integer warehouse_id:integer quantity_on_hand:integer reorder_level:integer last_restocked_at:timestamp", {"product_id": "products", "warehouse_id": "warehouses"}, {"reorder_level": "Stock below which to reorder."}),
]
#: Stored tables that hold values of a table above under another name.
STANDS_FOR = {"customer": "customers", "nation": "customers", "region": "customers"}
