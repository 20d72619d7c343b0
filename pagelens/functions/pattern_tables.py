"""Patterns of source text that make a page respond late (INP) or shift (CLS).

Of each: name, pattern, category, framework that it applies to (global: all) and severity. Letter case does not
count, and ^ and $ stand at lines.
"""

from __future__ import annotations

# What responds late to input.
INP = [
    ("addEventListener_discrete", r"addEventListener\s*\(\s*['\"]?(click|keydown|keyup|keypress|input|change|submit|pointerdown|pointerup|touchstart|touchend)['\"]?", "discrete_input", "global", "high"),
    ("on_event_assignment", r"\.(onclick|onkeydown|onkeyup|onkeypress|oninput|onchange|onsubmit)\s*=", "discrete_input", "global", "high"),
    ("html_inline_handler", r"(onclick|onkeydown|onkeyup|onkeypress|oninput|onchange|onsubmit)\s*=", "discrete_input", "global", "high"),
    ("classList_mutation", r"classList\.(add|remove|toggle)", "paint_trigger", "global", "medium"),
    ("attribute_mutation", r"(setAttribute|removeAttribute)\s*\(", "paint_trigger", "global", "medium"),
    ("innerHTML_mutation", r"(innerHTML|outerHTML|textContent)\s*=", "paint_trigger", "global", "high"),
    ("dom_child_manipulation", r"(appendChild|removeChild|replaceChild|insertBefore|insertAdjacentElement|insertAdjacentHTML)", "paint_trigger", "global", "high"),
    ("style_mutation", r"\.style\.[a-zA-Z]+\s*=", "paint_trigger", "global", "medium"),
    ("layout_thrash_read", r"(getBoundingClientRect|offsetHeight|offsetWidth|offsetTop|offsetLeft|scrollHeight|scrollWidth|scrollTop|scrollLeft|clientHeight|clientWidth)", "layout_thrash", "global", "high"),
    ("getComputedStyle", r"getComputedStyle\s*\(", "layout_thrash", "global", "high"),
    ("sync_loop_for", r"for\s*\([^)]+\)\s*\{", "sync_work", "global", "low"),
    ("sync_loop_while", r"while\s*\([^)]+\)\s*\{", "sync_work", "global", "low"),
    ("array_operations", r"(Array\.from|\.map\s*\(|\.reduce\s*\(|\.filter\s*\(|\.forEach\s*\()", "sync_work", "global", "low"),
    ("json_operations", r"JSON\.(parse|stringify)\s*\(", "sync_work", "global", "medium"),
    ("jquery_event_binding", r"\$\s*\(['\"][^'\"]+['\"]\)\s*\.\s*(on|click|change|submit|keydown|keyup|focus|blur)\s*\(", "discrete_input", "global", "high"),
    ("jquery_dom_manipulation", r"\$\s*\([^)]+\)\s*\.\s*(html|append|prepend|after|before|remove|empty|addClass|removeClass|toggleClass|css|attr|prop)\s*\(", "paint_trigger", "global", "medium"),
    ("react_event_props", r"on(Click|Change|Submit|KeyDown|KeyUp|KeyPress|Input|PointerDown|PointerUp|TouchStart|TouchEnd|Focus|Blur)\s*=\s*\{", "discrete_input", "react", "high"),
    ("react_setState", r"setState\s*\(", "paint_trigger", "react", "high"),
    ("react_useState", r"useState\s*\(", "paint_trigger", "react", "medium"),
    ("react_state_setter", r"set[A-Z][a-zA-Z0-9_]*\s*\([^)]*\)", "paint_trigger", "react", "high"),
    ("react_controlled_input", r"<input[^>]+value\s*=\s*\{", "discrete_input", "react", "high"),
    ("react_controlled_textarea", r"<textarea[^>]+value\s*=\s*\{", "discrete_input", "react", "high"),
    ("react_useLayoutEffect", r"useLayoutEffect\s*\(", "layout_thrash", "react", "high"),
    ("react_forceUpdate", r"forceUpdate\s*\(", "paint_trigger", "react", "high"),
    ("react_useReducer", r"useReducer\s*\(", "paint_trigger", "react", "medium"),
    ("nextjs_router_push", r"router\.push\s*\(", "paint_trigger", "nextjs", "high"),
    ("nextjs_router_replace", r"router\.replace\s*\(", "paint_trigger", "nextjs", "high"),
    ("nextjs_useRouter", r"useRouter\s*\(", "paint_trigger", "nextjs", "medium"),
    ("nextjs_server_action_form", r"<form[^>]+action\s*=\s*\{", "discrete_input", "nextjs", "high"),
    ("nextjs_dynamic_import", r"import\s*\(\s*['\"]", "sync_work", "nextjs", "medium"),
    ("nextjs_link_component", r"<Link[^>]+onClick", "discrete_input", "nextjs", "medium"),
    ("vue_event_directive", r"@(click|submit|change|input|keydown|keyup|keypress|focus|blur|touchstart|touchend)(\.[a-z]+)*\s*=", "discrete_input", "vue", "high"),
    ("vue_v_on_directive", r"v-on:(click|submit|change|input|keydown|keyup|keypress)\s*=", "discrete_input", "vue", "high"),
    ("vue_v_model", r"v-model(\.[a-z]+)*\s*=", "discrete_input", "vue", "high"),
    ("vue_ref_value_mutation", r"\.value\s*=", "paint_trigger", "vue", "high"),
    ("vue_reactive_mutation", r"this\.[a-zA-Z_$][a-zA-Z0-9_$]*\s*=", "paint_trigger", "vue", "medium"),
    ("vue_watch", r"watch\s*\(", "paint_trigger", "vue", "medium"),
    ("vue_computed", r"computed\s*\(", "paint_trigger", "vue", "low"),
    ("vue_emit", r"\$emit\s*\(|emit\s*\(", "paint_trigger", "vue", "medium"),
    ("html_button_handler", r"<button[^>]+on(click|keydown|keyup)\s*=", "discrete_input", "static", "high"),
    ("html_input_handler", r"<input[^>]+on(click|change|input|keydown|keyup|focus|blur)\s*=", "discrete_input", "static", "high"),
    ("html_form_handler", r"<form[^>]+on(submit|change)\s*=", "discrete_input", "static", "high"),
    ("html_select_handler", r"<select[^>]+on(change|click)\s*=", "discrete_input", "static", "high"),
    ("dom_query_selector", r"document\.(querySelector|querySelectorAll|getElementById|getElementsByClassName|getElementsByTagName)\s*\(", "paint_trigger", "static", "low"),
    ("prevent_default", r"preventDefault\s*\(", "discrete_input", "static", "medium"),
    ("quarto_panel_tabset", r"panel-tabset|\.panel-tabset", "discrete_input", "quarto", "high"),
    ("quarto_callout", r"\.callout|callout-", "paint_trigger", "quarto", "medium"),
    ("quarto_js", r"quarto\.js|quarto-nav|quarto-search", "discrete_input", "quarto", "high"),
    ("quarto_observable", r"ojs-|observable", "discrete_input", "quarto", "high"),
]

# What shifts a page's layout.
CLS = [
    ("img_no_dimensions", r"<img(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "high"),
    ("img_no_width", r"<img(?![^>]*width\s*=)[^>]+height\s*=[^>]*>", "missing_dimensions", "global", "high"),
    ("img_no_height", r"<img(?![^>]*height\s*=)[^>]+width\s*=[^>]*>", "missing_dimensions", "global", "high"),
    ("img_src_dynamic", r"<img[^>]+src\s*=\s*['\"]?\s*$|img\.src\s*=", "dynamic_injection", "global", "medium"),
    ("video_no_dimensions", r"<video(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "high"),
    ("iframe_no_dimensions", r"<iframe(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "high"),
    ("embed_no_dimensions", r"<embed(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "high"),
    ("object_no_dimensions", r"<object(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "medium"),
    ("canvas_no_dimensions", r"<canvas(?![^>]*(?:width|height)\s*=)[^>]*>", "missing_dimensions", "global", "medium"),
    ("svg_no_dimensions", r"<svg(?![^>]*(?:width|height|viewBox)\s*=)[^>]*>", "missing_dimensions", "global", "medium"),
    ("innerHTML_assignment", r"\.innerHTML\s*=", "dynamic_injection", "global", "high"),
    ("outerHTML_assignment", r"\.outerHTML\s*=", "dynamic_injection", "global", "high"),
    ("insertAdjacentHTML", r"insertAdjacentHTML\s*\(", "dynamic_injection", "global", "high"),
    ("appendChild", r"\.appendChild\s*\(", "dynamic_injection", "global", "medium"),
    ("insertBefore", r"\.insertBefore\s*\(", "dynamic_injection", "global", "high"),
    ("prepend", r"\.(prepend|before)\s*\(", "dynamic_injection", "global", "high"),
    ("document_write", r"document\.write\s*\(", "dynamic_injection", "global", "high"),
    ("createElement_img", r"createElement\s*\(\s*['\"]img['\"]\s*\)", "dynamic_injection", "global", "medium"),
    ("createElement_div", r"createElement\s*\(\s*['\"]div['\"]\s*\)", "dynamic_injection", "global", "low"),
    ("font_face_declaration", r"@font-face\s*\{", "font_loading", "css", "medium"),
    ("font_display_auto", r"font-display\s*:\s*(auto|block)\s*;", "font_loading", "css", "high"),
    ("font_display_swap", r"font-display\s*:\s*swap\s*;", "font_loading", "css", "medium"),
    ("google_fonts_link", r"fonts\.googleapis\.com|fonts\.gstatic\.com", "font_loading", "global", "medium"),
    ("typekit_fonts", r"use\.typekit\.net|typekit\.com", "font_loading", "global", "medium"),
    ("font_awesome", r"font-awesome|fontawesome", "font_loading", "global", "low"),
    ("webfont_loader", r"WebFont\.load|webfontloader", "font_loading", "global", "medium"),
    ("google_adsense", r"googlesyndication\.com|adsbygoogle|google_ad_client", "ads_embeds", "global", "high"),
    ("google_doubleclick", r"doubleclick\.net|googletag\.cmd", "ads_embeds", "global", "high"),
    ("amazon_ads", r"amazon-adsystem\.com", "ads_embeds", "global", "high"),
    ("ad_slot_div", r"<div[^>]+(ad-slot|ad-container|ad-wrapper|advertisement|banner-ad)[^>]*>", "ads_embeds", "global", "high"),
    ("twitter_embed", r"platform\.twitter\.com/widgets|twitter-tweet", "ads_embeds", "global", "high"),
    ("facebook_embed", r"connect\.facebook\.net|fb-post|fb-video", "ads_embeds", "global", "high"),
    ("instagram_embed", r"instagram\.com/embed|instagram-media", "ads_embeds", "global", "high"),
    ("youtube_embed", r"youtube\.com/embed|youtube-nocookie\.com", "ads_embeds", "global", "medium"),
    ("disqus_comments", r"disqus\.com|disqus_thread", "ads_embeds", "global", "high"),
    ("intercom_widget", r"intercom\.com|intercomSettings", "ads_embeds", "global", "medium"),
    ("drift_chat", r"drift\.com|driftt\.com", "ads_embeds", "global", "medium"),
    ("hubspot_forms", r"hsforms\.com|hbspt\.forms", "ads_embeds", "global", "medium"),
    ("animation_height", r"animation[^;]*height|@keyframes[^}]*height\s*:", "animations", "css", "high"),
    ("animation_width", r"animation[^;]*width|@keyframes[^}]*width\s*:", "animations", "css", "high"),
    ("animation_top", r"@keyframes[^}]*top\s*:", "animations", "css", "high"),
    ("animation_left", r"@keyframes[^}]*left\s*:", "animations", "css", "high"),
    ("animation_margin", r"@keyframes[^}]*margin", "animations", "css", "high"),
    ("animation_padding", r"@keyframes[^}]*padding", "animations", "css", "medium"),
    ("transition_height", r"transition[^;]*height", "animations", "css", "medium"),
    ("transition_width", r"transition[^;]*width", "animations", "css", "medium"),
    ("transition_all", r"transition\s*:\s*all", "animations", "css", "medium"),
    ("lazy_load_attribute", r"loading\s*=\s*['\"]lazy['\"]", "lazy_loading", "global", "low"),
    ("lazyload_class", r"class\s*=\s*['\"][^'\"]*lazy[^'\"]*['\"]", "lazy_loading", "global", "medium"),
    ("data_src_pattern", r"data-src\s*=", "lazy_loading", "global", "medium"),
    ("lazysizes_library", r"lazysizes|lazyload\.js", "lazy_loading", "global", "medium"),
    ("intersection_observer", r"IntersectionObserver", "lazy_loading", "global", "low"),
    ("skeleton_loader", r"skeleton|placeholder|shimmer", "skeleton_placeholder", "global", "low"),
    ("aspect_ratio_box", r"aspect-ratio\s*:|padding-bottom\s*:\s*\d+(\.\d+)?%", "skeleton_placeholder", "css", "low"),
    ("jquery_prepend", r"\$\([^)]+\)\.(prepend|before|insertBefore)\s*\(", "dynamic_injection", "global", "high"),
    ("jquery_append", r"\$\([^)]+\)\.(append|after|insertAfter)\s*\(", "dynamic_injection", "global", "medium"),
    ("jquery_html", r"\$\([^)]+\)\.html\s*\(", "dynamic_injection", "global", "medium"),
    ("jquery_load", r"\$\([^)]+\)\.load\s*\(", "dynamic_injection", "global", "high"),
    ("react_img_no_dimensions", r"<img[^>]+src\s*=\s*\{(?![^>]*(?:width|height))[^>]*/>", "missing_dimensions", "react", "high"),
    ("react_lazy_component", r"React\.lazy\s*\(|lazy\s*\(\s*\(\s*\)\s*=>", "lazy_loading", "react", "medium"),
    ("react_suspense", r"<Suspense", "lazy_loading", "react", "low"),
    ("react_conditional_render", r"\{[^}]*\?\s*<[A-Z][^:]*:\s*(null|<)", "dynamic_injection", "react", "medium"),
    ("react_dangerouslySetInnerHTML", r"dangerouslySetInnerHTML", "dynamic_injection", "react", "high"),
    ("react_portal", r"createPortal|ReactDOM\.createPortal", "dynamic_injection", "react", "medium"),
    ("react_loading_state", r"(isLoading|loading)\s*\?\s*", "dynamic_injection", "react", "medium"),
    ("react_use_effect_dom", r"useEffect\s*\([^)]*\{[^}]*(innerHTML|appendChild|insertBefore)", "dynamic_injection", "react", "high"),
    ("nextjs_image_no_size", r"<Image(?![^>]*(?:width|height|fill|layout\s*=\s*['\"]fill))[^>]*/>", "missing_dimensions", "nextjs", "high"),
    ("nextjs_image_component", r"import[^}]*Image[^}]*from\s*['\"]next/image['\"]|<Image", "missing_dimensions", "nextjs", "low"),
    ("nextjs_dynamic_import", r"dynamic\s*\(\s*\(\s*\)\s*=>\s*import", "lazy_loading", "nextjs", "medium"),
    ("nextjs_script_component", r"<Script[^>]+strategy\s*=\s*['\"]afterInteractive['\"]", "dynamic_injection", "nextjs", "medium"),
    ("nextjs_font_optimization", r"next/font|@next/font", "font_loading", "nextjs", "low"),
    ("vue_v_if_content", r"v-if\s*=\s*['\"][^'\"]+['\"]", "dynamic_injection", "vue", "medium"),
    ("vue_v_show", r"v-show\s*=", "dynamic_injection", "vue", "low"),
    ("vue_v_html", r"v-html\s*=", "dynamic_injection", "vue", "high"),
    ("vue_async_component", r"defineAsyncComponent|asyncComponent", "lazy_loading", "vue", "medium"),
    ("vue_transition", r"<transition|<Transition", "animations", "vue", "low"),
    ("vue_img_no_dimensions", r"<img[^>]+:src\s*=\s*['\"]?[^'\"]+['\"]?(?![^>]*(?:width|height))[^>]*>", "missing_dimensions", "vue", "high"),
    ("static_include_partial", r"\{%\s*include|\{\{\s*partial|<%=\s*include|@include", "dynamic_injection", "static", "low"),
    ("hugo_shortcode", r"\{\{<\s*\w+|shortcode", "dynamic_injection", "static", "low"),
    ("jekyll_responsive_image", r"\{%\s*responsive_image|\{%\s*picture", "missing_dimensions", "static", "low"),
    ("css_position_absolute", r"position\s*:\s*absolute", "animations", "css", "low"),
    ("css_position_fixed", r"position\s*:\s*fixed", "animations", "css", "low"),
    ("css_contain_layout", r"contain\s*:[^;]*(layout|strict|content)", "skeleton_placeholder", "css", "low"),
    ("css_min_height", r"min-height\s*:\s*\d+", "skeleton_placeholder", "css", "low"),
    ("css_transform_animation", r"@keyframes[^}]*(transform|translate|scale|rotate)", "animations", "css", "low"),
    ("css_will_change", r"will-change\s*:", "animations", "css", "low"),
]

#: Weight of a match by severity.
WEIGHTS = {"high": 3, "medium": 2, "low": 1}
